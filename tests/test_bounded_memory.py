"""Days and keys of any size pass through a task a batch at a time."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import simulators as S
from tidebook.streaming import live, ordered
from tidebook.plans.simulations import _arms

P = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)


@pytest.fixture
def seven(spark):
    """Python gets seven rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def loop(rows, limit, tell):
    """The packets of each arm's day through ArmDay, the whole day at hand."""
    out = []
    for key, g in rows.groupby(["arm", "date"], dropna=False):
        day, told = S.ArmDay(P, limit=limit), []
        for r in g.sort_values(["ts", "seq"]).itertuples(index=False):
            told += day.packet(r.symbol, r.ts, r.seq, r.ts.hour * 60 + r.ts.minute, (r.bid, r.bid_qty, r.ask, r.ask_qty))
        key = tuple(None if pd.isna(k) else k for k in key)
        out += [(*key, *(x[c] for c in tell)) for x in (told + day.close() if "exit_seq" in tell else day.positions())]
    return sorted(map(str, out))


@pytest.mark.parametrize("limit", [0.0, -2000.0])
def test_broker_takes_a_day_in_batches(spark, small, seven, limit):
    quotes = _arms(spark, small).filter("date < '2024-01-09'")
    # Days without an arm's name are a group as well.
    quotes = quotes.withColumn("arm", F.when(F.col("arm") == "control", F.col("arm")))
    rows = quotes.toPandas()
    trades, held = S.broker(quotes, P, limit=limit), S.broker_positions(quotes, P, limit=limit)
    for found, columns in ((trades, ("symbol", "exit_seq", "exit_method", "net_pnl")), (held, ("symbol", "seq", "trades", "day_net"))):
        got = sorted(str(tuple(r)) for r in found.select("arm", "date", *columns).collect())
        assert got == loop(rows, limit, columns) and len(got) > 20
    # A grouped map would hold the whole day in a task.
    assert "FlatMapGroupsInPandas" not in plan(trades) + plan(held)


@pytest.mark.parametrize("kind", ["int", "bigint", "double"])
def test_broker_arms_may_be_numbers(spark, small, seven, kind):
    """Arms with numbers for names, one of them without, trade as those with texts do."""
    quotes = _arms(spark, small).filter("date < '2024-01-05'").withColumn("arm", F.when(F.col("arm") == "expanded", F.col("symbol")))
    # Neighbours beyond 2^53 are one number to a double.
    number = F.when(F.col("arm").isNotNull(), F.lit(2**53 if kind == "bigint" else -1) + F.locate("k", "arm") % 3 + F.length("arm")).cast(kind)
    numbered = quotes.withColumn("arm", number)
    name = {r["number"]: r["arm"] for r in quotes.select("arm", number.alias("number")).distinct().collect()}
    for op, columns in ((S.broker, ("symbol", "exit_seq", "exit_method", "net_pnl")), (S.broker_positions, ("symbol", "seq", "trades", "day_net"))):
        found = op(numbered, P, limit=-2000.0)
        assert dict(found.dtypes)["arm"] == kind
        got = sorted(str((name[r["arm"]], *r[1:])) for r in found.select("arm", "date", *columns).collect())
        want = sorted(str(tuple(r)) for r in op(quotes, P, limit=-2000.0).select("arm", "date", *columns).collect())
        assert got == want and any(r.startswith("(None") for r in got)


def test_zeros_and_nans_are_arms_of_their_own(spark):
    """-0.0 is the arm 0.0, as for a grouping; missing arms and NaN are not mixed."""
    at = dt.datetime(2024, 3, 1, 10)
    rows = [(arm, "2024-03-01", "x", at + dt.timedelta(seconds=k), k, 100.0, 900, 100.4, 100) for k, arm in enumerate([0.0, -0.0, None, None, float("nan"), float("nan"), float("nan")])]
    df = spark.createDataFrame(rows, "arm double, date string, symbol string, ts timestamp, seq long, bid double, bid_qty long, ask double, ask_qty long")
    assert sorted((str(r["arm"]), r["seq"]) for r in S.broker_positions(df, P).collect()) == [("0.0", 1), ("None", 3), ("nan", 6)]


def test_no_query_of_the_broker_holds_a_day(spark, small):
    from tidebook.plans import QUERIES

    for name in ("e3_broker", "e4_day_risk", "e5_replay", "e6_fill_haircut", "e12_live_positions"):
        text = plan(QUERIES[name](spark, small))
        assert "MapInPandas" in text and "FlatMapGroupsInPandas" not in text, name


def test_broker_stream_deals_out_days(spark, tmp_path):
    """An arm's days are groups of their own, so a late packet of one leaves the next as it is."""
    at = lambda day, s: dt.datetime(2026, 6, day, 10, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    quotes = [(100.0, 100.0, 100.4, 100.0), (100.0, 900.0, 100.4, 100.0), (99.8, 900.0, 100.2, 100.0), (100.6, 100.0, 101.0, 100.0)]
    p = S.Strategy(entry_threshold=0.05, max_hold=500, min_hold=400, order_timeout=50, edge_margin=0.0, queue_fill=0.0, stop_ticks=0.0)
    schema = "arm string, symbol string, ts timestamp, seq long, bid double, bid_qty double, ask double, ask_qty double"
    rows = lambda day, ks: [("a", "x", at(day, k), 10 * day + k, *quotes[k]) for k in ks]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Both days begin in the first file; the second has a packet of the first day, one of the second, and one of the fourth.
    for part in (rows(1, (0, 1, 2)) + rows(2, (0, 1, 2)), rows(1, (3,)) + rows(2, (3,)) + rows(4, (0,))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live.run_available(live.broker_stream(feed, p, late="48 hours"), out, str(tmp_path / "state"))
    told = sorted(tuple(r) for r in spark.read.parquet(out).select("date", "exit_seq", "exit_method", "entry_price").collect())
    # The day before the watermark of the fourth day is closed, at its own last packet.
    assert told == [("2026-06-01", 13, "taker_eod", 100.0)]


def test_positions_of_an_older_day_are_not_told(spark, tmp_path):
    """A day that is closed after the next has begun leaves the newer position in the snapshot."""
    from tidebook.sources.logs import read_snapshot

    schema = "kind string, arm string, " + S.POSITIONS + ", seq long, packet_at timestamp, net_pnl double"
    row = lambda day, side: ("position", "a", "x", side, 1.0, 1.0, 550, 0.0, 0, False, 0, 0, 0, 0, 0.0, 0.0, False, day, dt.datetime(2026, 6, day), None)
    path = str(tmp_path / "live.json")
    for day, side in ((1, 1), (2, -1), (1, 0)):
        live.telemetry(spark.createDataFrame([row(day, side)], schema), path)
    assert read_snapshot(path)["arms"]["a"]["positions"]["x"]["direction"] == -1


class Sizes(ordered.Numbered):
    """Tells how many packets a fold gets at once."""

    adds = "n long, gap_s double, at_once long"

    @staticmethod
    def step(rows, held):
        out, held = ordered.Numbered.step(rows, held)
        return out.assign(at_once=len(rows)), held


def test_ordered_packets_are_held_by_slots(spark, tmp_path):
    key, store = ordered.STORE
    spark.conf.set(key, store)
    try:
        t0, schema, folder = dt.datetime(2024, 3, 1, 9, tzinfo=dt.timezone.utc), "symbol string, ts timestamp, seq long", str(tmp_path / "in")
        at = lambda k: ("A", t0 + dt.timedelta(seconds=k), k)
        shuffled = [at((k * 37) % 1000) for k in range(1000)]
        for part in (shuffled[:500] + shuffled[:100], shuffled[500:] + shuffled[200:300], [at(1055)], [at(5000)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        live.run_available(ordered.ordered_stream(feed, "1000 seconds", fold=Sizes, slot=20), str(tmp_path / "out"), str(tmp_path / "state"))
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    finally:
        spark.conf.unset(key)
    assert [(r["n"], r["seq"]) for r in rows] == [(k + 1, k) for k in range(1000)] + [(1001, 1055)]
    assert max(r["at_once"] for r in rows) == 20


def test_rolling_z_is_the_windows(spark):
    """Digit by digit, with gaps, constant stretches and across blocks; p23 has no sliding window left."""
    from tidebook.functions import columns as C
    from tidebook.operators import recurrences as R
    from tidebook.plans import QUERIES

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 3, 400), 2)
    x[rng.random(400) < 0.2] = np.nan
    x[200:330] = 1.5
    rows = [("a", dt.date(2024, 1, 1), k, k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, ts long, seq long, x double")
    want = [r["z"] for r in df.withColumn("z", C.zscore(F.col("x"), C.session(), 100, 20)).orderBy("seq").collect()]
    before, R.BLOCK = R.BLOCK, 64
    try:
        got = R.rolling_z(x, 100, 20)
    finally:
        R.BLOCK = before
    assert [None if np.isnan(v) else v for v in got] == want and sum(v is not None for v in want) > 200
    assert "stddev_samp" not in plan(QUERIES["p23_data_driven_composite"](spark, "/root/testdata/sf0.001")).split("Subquery")[0]


def test_report_joins_trades_once(spark, small):
    from tidebook.plans import QUERIES

    for name in ("u10_arm_report", "u8_paired_bootstrap", "u7_pbo"):
        assert "lineitem" not in plan(QUERIES[name](spark, small))
