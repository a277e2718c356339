"""Streams out of order, late and doubled, against batches; and the folds that follow them."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import sessions as Z
from tidebook.streaming import live, ordered

T0 = dt.datetime(2024, 3, 1, 9, 20, tzinfo=dt.timezone.utc)
QUOTES = "symbol string, date date, ts timestamp, seq long, bid double, ask double, bid_qty long, ask_qty long"


def quotes(n, symbol="A", seed=1):
    rng = random.Random(seed)
    out, mid = [], 100.0
    for k in range(n):
        mid += rng.choice((-0.05, 0.0, 0.05, 0.1))
        half = rng.choice((0.05, 0.1, 0.15))
        out.append((symbol, dt.date(2024, 3, 1), T0 + dt.timedelta(milliseconds=400 * k + rng.randrange(300)), k, mid - half, mid + half, rng.randrange(1, 5000), rng.randrange(1, 5000)))
    return out


def batch_features(spark, rows, calib):
    df = spark.createDataFrame(rows, QUOTES).withColumn("calib", F.lit(calib))
    return Z.session_features(df).orderBy("symbol", "seq").toPandas()


@pytest.mark.parametrize("cuts", [(1, 2, 3, 60), (7,), (), (199,)])
def test_fold_gives_the_windows_values(spark, cuts):
    rows = quotes(200)
    want = batch_features(spark, rows, 700.0)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in QUOTES.split(", ")])
    held, parts = Z.SessionFold.start(700.0), []
    for s, e in zip((0, *cuts), (*cuts, len(rows))):
        out, held = Z.SessionFold.step(frame.iloc[s:e].reset_index(drop=True), held)
        assert all(len(x) <= Z.WIDTH for x in held[1:4])
        parts.append(out)
    got = pd.concat(parts)
    for c in ("mid", "micro_deviation", "velocity", "flow", "flow_sum", "bid_size_ratio", "ask_size_ratio", "order_size"):
        np.testing.assert_array_equal(got[c].to_numpy(float), want[c].to_numpy(float), err_msg=c)  # digit by digit
    for c in ("mid_ema", "log_spread_z"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, err_msg=c)


def test_projections(spark):
    df = Z.session_features(spark.createDataFrame(quotes(30), QUOTES).withColumn("calib", F.lit(10.0)))
    assert Z.taker_rows(df, "flow_sum").columns == ["symbol", "date", "seq", "ts", "mid", "signal"]
    assert Z.maker_rows(df, "velocity").columns == ["symbol", "date", "seq", "ts", "mid", "bid", "ask", "signal"]
    assert Z.maker_rows(df, "velocity").filter("signal IS NOT NULL").count() == 20
    none = Z.session_features(spark.createDataFrame(quotes(30), QUOTES).withColumn("calib", F.lit(None).cast("double")))
    assert none.count() == 0


@pytest.fixture
def store(spark):
    key, value = ordered.STORE
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key)


def send(spark, parts, schema, folder):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)



def test_shuffled_doubled_stream_equals_batch(spark, store, tmp_path):
    rows = quotes(120) + quotes(90, "B", 2) + quotes(40, "C", 3)  # C has no calibration
    rng = random.Random(4)
    sent = [(r[2] + dt.timedelta(seconds=rng.uniform(0, 5)), r) for r in rows]
    sent += [(r[2] + dt.timedelta(seconds=rng.uniform(0, 5)), r) for r in rows if rng.random() < 0.4]
    sent = [r for _, r in sorted(sent)]
    parts = [sent[i : i + 90] for i in range(0, len(sent), 90)]
    for p in parts:
        rng.shuffle(p)
    last = list(rows[0])
    last[2], last[3] = T0 + dt.timedelta(hours=1), 10_000
    feed = send(spark, [*parts, [tuple(last)]], QUOTES, str(tmp_path / "in"))
    initial = spark.createDataFrame([("A", dt.date(2024, 3, 1), 700.0), ("B", dt.date(2024, 3, 1), 900.0)], "symbol string, date date, calib double")
    out = ordered.ordered_stream(feed, "40 seconds", fold=Z.SessionFold, keys=("symbol", "date"), initial=initial)
    live.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("symbol", "seq").toPandas()
    want = pd.concat([batch_features(spark, rows[:120], 700.0), batch_features(spark, rows[120:210], 900.0)])
    assert got[["symbol", "seq"]].values.tolist() == want[["symbol", "seq"]].values.tolist()
    for c in (*Z.FEATURES, "order_size"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, err_msg=c)


def test_late_packets_go_and_a_restart_goes_on(spark, store, tmp_path):
    schema = "symbol string, ts timestamp, seq long, x double, note string"
    row = lambda s, seq=None: ("A", T0 + dt.timedelta(seconds=s), s if seq is None else seq, None if s % 2 else float(s), None)
    folder, paths = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "state"))
    feed = send(spark, [[row(3), row(1), row(1), row(2)], [row(20), row(5)]], schema, folder)
    live.run_available(ordered.ordered_stream(feed, "10 seconds"), *paths)
    first = spark.read.parquet(paths[0]).orderBy("n").select("n", "seq", "gap_s", "x").collect()
    assert [tuple(r) for r in first] == [(1, 1, None, None), (2, 2, 1.0, 2.0), (3, 3, 1.0, None), (4, 5, 2.0, None)]
    # 4 is too late, 5 comes again; 20 waited over the restart and its double goes.
    feed = send(spark, [[row(4), row(5), row(20), row(15), row(40)], [row(41)]], schema, folder)
    live.run_available(ordered.ordered_stream(feed, "10 seconds"), *paths)
    told = spark.read.parquet(paths[0]).orderBy("n").select("n", "seq").collect()
    assert [tuple(r) for r in told] == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 15), (6, 20)]
