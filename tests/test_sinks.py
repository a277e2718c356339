"""File catalog, session sinks, compaction, batch logs and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidebook.sources import depth, logs, shared, sinks

ROWS = "trading_date date, symbol string, ts timestamp, seq long, bid double"


def rows(spark, n=40):
    t0 = dt.datetime(2026, 6, 1, 4, 0)
    made = [(dt.date(2026, 6, 1 + k % 2), "ABC-Jun2026-FUT" if k % 4 < 2 else "XYZ-Jun2026-FUT", t0 + dt.timedelta(seconds=n - k), k, float(k)) for k in range(n)]
    return spark.createDataFrame(made, ROWS)


def told(df):
    return sorted(tuple(r) for r in df.select("trading_date", "symbol", "seq", "bid").collect())


def test_catalog_opens_no_file_and_plans_join_nothing(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_sessions(rows(spark), root)
    files = depth.catalog(spark, root)
    assert {tuple(r) for r in files.select(*depth.LAYOUT).distinct().collect()} == {tuple(r) for r in rows(spark).select(*depth.LAYOUT).distinct().collect()}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    df = depth.recordings(spark, root, symbols=["ABC"], dates=["2026-06-01"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "PartitionFilters: [" in plan
    assert {r["underlying"] for r in df.collect()} == {"ABC"}
    assert len(df.inputFiles()) == 1
    assert depth.recordings(spark, root, symbols=["NONE"]).count() == 0


def test_sessions_are_replaced_whole_and_sorted(spark, tmp_path):
    root = str(tmp_path / "panel")
    sinks.write_sessions(rows(spark), root)
    part = rows(spark).filter("symbol = 'ABC-Jun2026-FUT' AND trading_date = DATE '2026-06-01'")
    for _ in range(2):
        sinks.write_sessions(part.withColumn("bid", F.col("bid") + 100), root)
    found = spark.read.parquet(root)
    want = rows(spark).withColumn("bid", F.when(F.expr("symbol = 'ABC-Jun2026-FUT' AND trading_date = DATE '2026-06-01'"), F.col("bid") + 100).otherwise(F.col("bid")))
    assert told(found) == told(want)
    for file in (tmp_path / "panel").rglob("*.parquet"):
        order = [(r["ts"], r["seq"]) for r in spark.read.parquet(str(file)).collect()]
        assert order == sorted(order)


def test_compaction_is_seen_whole_and_runs_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a")
    for _ in range(2):
        rows(spark).write.mode("append").partitionBy(*depth.LAYOUT).parquet(root)
    assert depth.recordings(spark, root).count() == 80
    # It ends early, after one session has its file.
    moved = []

    def once(*a):
        if moved:
            raise OSError("lost")
        moved.append(a)
        return shared.move(*a)

    monkeypatch.setattr(sinks, "move", once)
    with pytest.raises(OSError):
        sinks.compact(spark, root, unique=("ts", "seq"))
    assert depth.recordings(spark, root).count() == 70
    monkeypatch.undo()
    assert sinks.compact(spark, root, unique=("ts", "seq")) == 3
    assert sinks.compact(spark, root, unique=("ts", "seq")) == 0
    assert told(depth.recordings(spark, root)) == told(rows(spark))


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_a_batch_that_is_tried_again_is_there_once(spark, tmp_path, form):
    root = str(tmp_path / "log")
    df = spark.range(100).select("id", (F.col("id") / 4).alias("x"))
    sinks.write_batch(df.filter("id < 50"), 0, root, form)
    broken = df.filter("id >= 50").withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_batch(broken, 1, root, form)
    for _ in range(2):
        sinks.write_batch(df.filter("id >= 50"), 1, root, form)
    found = sinks.read_batches(spark, root, "id long, x double", form)
    assert sorted((r["id"], r["x"], r["batch"]) for r in found.collect()) == [(k, k / 4, int(k >= 50)) for k in range(100)]


def test_log_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "log")
    sinks.log_stream(feed, root, str(tmp_path / "state")).awaitTermination()
    # A batch that was written but not noted comes again.
    (tmp_path / "state" / "commits" / "2").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    sinks.log_stream(feed, root, str(tmp_path / "state")).awaitTermination()
    found = sinks.read_batches(spark, root, "id long").collect()
    assert sorted(r["id"] for r in found) == list(range(30)) and {r["batch"] for r in found} == {0, 1, 2}


def test_snapshots_by_url(spark, tmp_path):
    path = f"file://{tmp_path}/live.json"
    assert logs.read_snapshot(path) is None
    for k in range(3):
        logs.write_snapshot({"k": k, "name": "naïve"}, path)
        assert logs.read_snapshot(path) == {"k": k, "name": "naïve"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["live.json"]
    assert json.loads((tmp_path / "live.json").read_text()) == {"k": 2, "name": "naïve"}


def test_front_month_of_wanted_symbols(spark):
    df = spark.createDataFrame([("A", 1, dt.date(2026, 6, 25)), ("A", 2, dt.date(2026, 7, 30)), ("B", 3, dt.date(2026, 1, 1))], "symbol string, security_id long, expiry date")
    asked = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    got = logs.front_month(df, dt.date(2026, 6, 1), wanted=asked("A", "A")).collect()
    assert [tuple(r) for r in got] == [("A", 1, dt.date(2026, 6, 25))]
    with pytest.raises(Exception, match="no contract of B expires on or after 2026-06-01"):
        logs.front_month(df, dt.date(2026, 6, 1), wanted=asked("A", "B")).collect()
    assert logs.front_month(df, dt.date(2026, 6, 1)).count() == 1
