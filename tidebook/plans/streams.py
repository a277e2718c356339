"""Structured Streaming runs over the event files, with the batch result's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import sessions as Z
from tidebook.operators import simulators as S
from tidebook.sources import depth as D
from tidebook.sources import views as V
from tidebook.sources.shared import shared_folder
from tidebook.streaming import live, ordered

from .dynamics import ema_sql
from .features import _MICRO, W, _flow, _lag, _z, frame
from .registry import query, rounded, shown


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of ticks with a zoned time."""
    return _ticks(spark.readStream.schema(V.load(spark, d, "events").schema).parquet(f"{d}/events.parquet*"))


def _ticks(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id", F.col("value").alias("mid"))


def _ran(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    out = shared_folder(spark, name)
    live.run_available(df, f"{out}/rows", f"{out}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query(V.with_views("ticks") + ", b AS (SELECT symbol, date_trunc('hour', ts) AS hour, arg_max(mid, (ts, seq)) AS close, count(*) AS n FROM ticks GROUP BY ALL) SELECT symbol, epoch(hour)::BIGINT AS start, close, n FROM b WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks)")
def t10_bar_stream(spark, d):
    """Hours that the watermark has passed."""
    return _ran(spark, live.bar_stream(_stream(spark, d)), "bars").withColumn("start", F.unix_timestamp("start"))


_PAIRS = """, o AS (SELECT symbol, seq, CASE WHEN k % 3 = 0 THEN 'ask' ELSE 'bid' END AS side, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks),
    s AS (SELECT symbol, rn, CASE WHEN side = 'bid' THEN seq END AS b, CASE WHEN side = 'ask' THEN seq END AS a FROM o WHERE rn = 1
      UNION ALL SELECT o.symbol, o.rn, CASE WHEN o.side = 'bid' THEN o.seq WHEN s.a IS NOT NULL AND s.b IS NOT NULL THEN NULL ELSE s.b END,
        CASE WHEN o.side = 'ask' THEN o.seq WHEN s.a IS NOT NULL AND s.b IS NOT NULL THEN NULL ELSE s.a END FROM s JOIN o ON o.symbol = s.symbol AND o.rn = s.rn + 1)
    SELECT symbol, b AS bid_seq, a AS ask_seq FROM s WHERE a IS NOT NULL AND b IS NOT NULL"""


@query(V.with_views("ticks") + _PAIRS)
def t2_pair_stream(spark, d):
    messages = _stream(spark, d).select("symbol", "ts", "seq", F.when(F.col("k") % 3 == 0, "ask").otherwise("bid").alias("side"))
    return _ran(spark, live.pair_stream(messages), "pairs")


ARMS = [("control", "click"), ("control", "view"), *[("expanded", s) for s in ("click", "error", "purchase", "signup", "view")]]


def _packets(ticks: DataFrame) -> DataFrame:
    half = 0.05 * (1 + F.col("k") % 5)
    bid = F.when(F.col("seq") % 97 == 0, 0.0).otherwise(F.col("mid") - half)
    return ticks.select("symbol", "ts", "seq", bid.alias("bid"), (100 * (1 + F.col("user_id") % 17)).alias("bid_qty"), (F.col("mid") + half).alias("ask"), (100 * (1 + F.col("k") % 13)).alias("ask_qty"))


@query()
def t5_broker_stream(spark, d):
    """The broker of e3 as keyed state; a day closes at midnight, the last one while the stream has not passed it stays open."""
    p = S.Strategy(entry_threshold=0.05, max_hold=20, min_hold=2, order_timeout=4, edge_margin=0.1, queue_fill=0.0, last_entry=1440)
    arms = spark.createDataFrame(ARMS, "arm string, symbol string")
    trades = _ran(spark, live.broker_stream(live.fan_out(_packets(_stream(spark, d)), arms), p), "broker")
    return shown(trades, ("arm", "date", "symbol", "exit_seq", "direction", "exit_method", "hold_packets"), "entry_price", "exit_price", "net_pnl", digits=4)


#: Parts in which the shuffled feed arrives, hours that a packet may be under way, and how late the streams take packets:
#: no packet comes later than the span of a part and its way.
PARTS, WAY_H, LATE_H = 8, 6, 104


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of many batches: out of order by up to WAY_H hours and more, a third of them twice."""
    events = V.load(spark, d, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    way = lambda salt: F.col("ts") + F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(WAY_H * 3600)))
    sent = events.withColumn("at", way(1)).unionByName(events.filter("event_id % 3 = 0").withColumn("at", way(2)))
    part = F.floor(F.timestamp_diff("SECOND", F.lit(first), F.col("at")) * PARTS / max(1, (last - first).total_seconds()))
    sent = sent.withColumn("part", F.least(part, F.lit(PARTS - 1)))
    folder = shared_folder(spark, "feed")
    for k in range(PARTS):  # one after the other, so that they arrive in this order
        sent.filter(F.col("part") == k).drop("at", "part").repartition(2, F.xxhash64("event_id", F.lit(3))).write.mode("append").parquet(folder)
    return _ticks(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder))


def _ran_with_timers(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    key, store = ordered.STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        return _ran(spark, df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Times that the watermark has reached in the end.
_MARK = "mark AS (SELECT (epoch_us(max(ts)) // 1000 - %d * 3600000) * 1000 AS mark FROM {})" % LATE_H


@query(V.with_views("ticks") + ", " + _MARK.format("ticks") + """ SELECT symbol, seq, row_number() OVER w AS n, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS gap_s
    FROM ticks, mark WHERE epoch_us(ts) <= mark WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)""")
def t9_ordered_stream(spark, d):
    """Packets that came out of order and twice, numbered in their order, as far as the watermark has come."""
    found = _ran_with_timers(spark, ordered.ordered_stream(_shuffled(spark, d), f"{LATE_H} hours"), "ordered")
    return found.select("symbol", "seq", "n", F.round("gap_s", 6).alias("gap_s"))


_SESSION = (
    V.with_views("clean")
    + f""", c AS (SELECT symbol, date, median(bid_qty) AS m FROM quotes GROUP BY ALL), k AS (SELECT symbol, date, lag(m) OVER (PARTITION BY symbol ORDER BY date) AS calib FROM c),
    s AS (SELECT *, (bid + ask) / 2 AS mid, ln(greatest(ask - bid, 1e-6::DOUBLE)) AS lg FROM clean JOIN k USING (symbol, date) WHERE calib IS NOT NULL),
    l AS (SELECT *, {", ".join(f"{_lag(c)} AS p_{c}" for c in ("bid", "bid_qty", "ask", "ask_qty"))}, row_number() OVER {W} AS rn FROM s),
    f AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE {_flow("bid", "bid_qty", True)} - {_flow("ask", "ask_qty", False)} END::DOUBLE AS flow FROM l),
    g AS (SELECT *, {_MICRO} AS micro_deviation, mid - {_lag("mid", 10)} AS velocity, CASE WHEN count(flow) OVER {frame(20)} >= 20 THEN sum(flow) OVER {frame(20)} END AS flow_sum,
        {_z("lg", 50, 10)} AS log_spread_z, bid_qty / calib AS bid_size_ratio, ask_qty / calib AS ask_size_ratio, 10 * calib AS order_size FROM f), """
    + ema_sql("s", "mid", 2 / 33)
    + ", h AS (SELECT g.*, e.y AS mid_ema FROM g JOIN e USING (symbol, date, seq))"
)
_FEATURES = ("mid", "micro_deviation", "velocity", "flow", "flow_sum", "mid_ema", "bid_size_ratio", "ask_size_ratio", "order_size")
_SHOWN = rounded(*_FEATURES) + ", " + rounded("log_spread_z", digits=4)


def _shown_features(df: DataFrame) -> DataFrame:
    rest = [F.col(c) for c in _FEATURES]
    out = df.select("symbol", "seq", *[(F.round(c, 6) + 0.0) for c in rest], (F.round("log_spread_z", 4) + 0.0))
    return out.toDF("symbol", "seq", *_FEATURES, "log_spread_z")


@query(_SESSION + f" SELECT symbol, seq, {_SHOWN} FROM h")
def s9_session_features(spark, d):
    """Features of all packets of all sessions that have a calibration."""
    calib = D.calibration(V.quotes(spark, d))
    return _shown_features(Z.session_features(V.clean(V.quotes(spark, d)).join(calib, ["symbol", "date"])))


@query(_SESSION + ", " + _MARK.format("clean") + f" SELECT symbol, seq, {_SHOWN} FROM h, mark WHERE epoch_us(ts) <= mark")
def s9_feature_stream(spark, d):
    """The same features from a shuffled, doubled stream; a session starts from the calibration of the day before."""
    calib = D.calibration(V.quotes(spark, d)).filter("calib IS NOT NULL")
    ticks = _shuffled(spark, d)
    quotes = V.clean(_packets(ticks).withColumn("date", F.to_date("ts")))
    out = ordered.ordered_stream(quotes, f"{LATE_H} hours", fold=Z.SessionFold, keys=("symbol", "date"), initial=calib)
    return _shown_features(_ran_with_timers(spark, out, "features"))
