"""Scans and session preparation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.sources import depth as D
from tidebook.sources import logs as L
from tidebook.sources import packets as P
from tidebook.sources import sinks as K
from tidebook.sources import views as V
from tidebook.sources.shared import shared_folder

from .features import W
from .registry import query, rounded, shown
from .relations import _M

KEYS = ("symbol", "seq")
_IN = "ts >= CAST(date AS TIMESTAMP) + INTERVAL '9 hours 20 minutes' AND ts <= CAST(date AS TIMESTAMP) + INTERVAL '15 hours 25 minutes'"
Q = V.with_views("quotes")


def _recorded(spark, d):
    """The quotes as an archive by date and contract in which each session lies twice, sessions of even days being compacted."""
    q = V.quotes(spark, d).select(F.col("date").alias("trading_date"), F.concat(F.upper("symbol"), F.lit("-Jun2026-FUT")).alias("symbol"), "ts", "seq", "bid", "ask", "bid_qty", "ask_qty")
    root = shared_folder(spark, "archive")
    K.write_sessions(q, root)
    q.repartition(*D.LAYOUT).write.mode("append").partitionBy(*D.LAYOUT).parquet(root)
    K.compact(spark, root, F.day("trading_date") % 2 == 0, unique=("ts", "seq"))
    return root


_TWICE = Q + ", a AS (SELECT * FROM quotes UNION ALL SELECT * FROM quotes WHERE day(date) % 2 = 1)"


@query(_TWICE + " SELECT upper(symbol) AS underlying, date AS trading_date, seq, round(bid, 6) + 0.0 AS bid FROM a WHERE symbol IN ('click', 'view')")
def s1_recordings(spark, d):
    """Two underlyings of an archive; of sessions that were compacted only the compacted file is read."""
    df = D.recordings(spark, _recorded(spark, d), symbols=["CLICK", "VIEW"])
    return shown(D.one_contract(df), ("underlying", "trading_date", "seq"), "bid")


@query(_TWICE + " SELECT date AS trading_date, upper(symbol) || '-Jun2026-FUT' AS symbol, count(*) AS n, (count(*) > count(DISTINCT seq))::BOOLEAN AS doubled FROM a WHERE day(date) IN (3, 4) GROUP BY ALL")
def s7_session_files(spark, d):
    """Rows of all symbols on two days: one compacted, one of many files."""
    root = _recorded(spark, d)
    days = [str(r[0]) for r in D.catalog(spark, root).filter(F.day("trading_date").isin(3, 4)).select("trading_date").distinct().collect()]
    df = D.recordings(spark, root, dates=days)
    return df.groupBy("trading_date", "symbol").agg(F.count("*").alias("n"), (F.count("*") > F.count_distinct("seq")).alias("doubled"))


@query(Q + " SELECT symbol, date, seq, round(ask, 6) + 0.0 AS ask FROM quotes WHERE symbol <> 'view' UNION ALL SELECT symbol, date, seq, round(ask + 1, 6) + 0.0 FROM quotes WHERE symbol = 'view'")
def s19_session_sink(spark, d):
    """Sessions written, and those of one symbol again with other prices: they replace what was there."""
    q = V.quotes(spark, d).select("symbol", "date", "ts", "seq", "ask")
    root = shared_folder(spark, "panel")
    K.write_sessions(q, root, keys=("date", "symbol"))
    K.write_sessions(q.filter("symbol = 'view'").withColumn("ask", F.col("ask") + 1), root, keys=("date", "symbol"))
    return shown(spark.read.parquet(root), ("symbol", "date", "seq"), "ask")


@query(V.with_views("trades") + " SELECT order_key % 3 AS batch, order_key, line, net_pnl FROM trades")
def s20_batch_log(spark, d):
    """A log of three batches, one of which was tried twice."""
    t = V.trades(spark, d).select("order_key", "line", "net_pnl")
    root = shared_folder(spark, "log")
    for k in (0, 1, 1, 2):
        K.write_batch(t.filter(F.col("order_key") % 3 == k), k, root, "csv")
    return K.read_batches(spark, root, "order_key long, line long, net_pnl double", "csv").select("batch", "order_key", "line", "net_pnl")


@query(V.with_views("trades") + " SELECT arm, count(*) AS trades, round(sum(net_pnl), 2) AS net FROM trades GROUP BY arm")
def s21_snapshot(spark, d):
    """Totals of the arms by way of a snapshot, into which one of two batches comes twice."""
    from tidebook.streaming import live

    t = V.trades(spark, d)
    path = shared_folder(spark, "snapshot") + ".json"
    for k in (0, 1, 1):
        live.telemetry(t.filter(F.col("order_key") % 2 == k), path, now=0.0, batch_id=k)
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "arms map<string, struct<trades: long, net: double>>").alias("s"))
    return held.select(F.explode("s.arms").alias("arm", "t")).select("arm", "t.trades", F.round("t.net", 2).alias("net"))


@query(Q + f" SELECT symbol, seq, {rounded('(bid + ask) / 2 AS mid', 'ask - bid AS spread')} FROM quotes WHERE {_IN}")
def s2_session_prep(spark, d):
    """Zero and crossed rows stay here, as the research scan keeps them."""
    q = V.quotes(spark, d).filter(D.in_session())
    return shown(q.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")}), KEYS, "mid", "spread")


@query(Q + f" SELECT symbol, seq FROM quotes WHERE {_IN} QUALIFY count(*) OVER (PARTITION BY symbol, date) >= 18")
def s3_least_rows(spark, d):
    return D.sessions(V.quotes(spark, d), 18)[0].select(*KEYS)


@query(Q + f" SELECT symbol, date, count(CASE WHEN {_IN} THEN 1 END) AS n FROM quotes GROUP BY ALL HAVING count(CASE WHEN {_IN} THEN 1 END) < 18")
def s4_skipped_sessions(spark, d):
    return D.sessions(V.quotes(spark, d), 18)[1]


@query(_M + f" SELECT symbol, seq, {rounded('mid', '(bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) - mid AS micro_dev', f'coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER {W}), 0) / 1e6::DOUBLE AS dt')} FROM m")
def s6_first_level_scan(spark, d):
    return shown(D.first_level(V.quotes(spark, d)), KEYS, "mid", "micro_dev", "dt")


@query(Q + ", c AS (SELECT symbol, date, median(bid_qty) AS m FROM quotes GROUP BY ALL) SELECT symbol, date, lag(m) OVER (PARTITION BY symbol ORDER BY date) AS calib FROM c")
def s8_calibration(spark, d):
    return D.calibration(V.quotes(spark, d))


@query(
    Q
    + f""", c AS (SELECT symbol, date, median(bid_qty) AS m FROM quotes GROUP BY ALL), l AS (SELECT symbol, date, lag(m) OVER (PARTITION BY symbol ORDER BY date) AS calib FROM c)
    SELECT symbol, seq, calib, 10 * calib AS order_size, bid_qty > calib AS active FROM quotes JOIN l USING (symbol, date) WHERE calib IS NOT NULL AND {_IN}"""
)
def s9_session_stream(spark, d):
    """Session rows with the day before's calibration; days without one go. A row a symbol's day is joined."""
    q = V.quotes(spark, d)
    c = D.calibration(q).filter("calib IS NOT NULL")
    out = q.filter(D.in_session()).join(c, ["symbol", "date"])
    return out.select(*KEYS, "calib", (10 * F.col("calib")).alias("order_size"), (F.col("bid_qty") > F.col("calib")).alias("active"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS not_a_number FROM events")
def s12_tolerant_numbers(spark, d):
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    return V.load(spark, d, "events").select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number(F.col("event_type")).alias("not_a_number"))


@query(
    "SELECT symbol, security_id, expiry FROM (SELECT c_mktsegment AS symbol, o_orderkey AS security_id, CAST(o_orderdate AS DATE) AS expiry FROM orders JOIN customer ON o_custkey = c_custkey) WHERE expiry >= DATE '1997-06-15' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY expiry, security_id) = 1"
)
def s14_front_month(spark, d):
    o, c = V.load(spark, d, "orders"), V.load(spark, d, "customer")
    segments = c.select(F.col("c_mktsegment").alias("symbol"))
    m = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("symbol"), F.col("o_orderkey").alias("security_id"), F.to_date("o_orderdate").alias("expiry"))
    import datetime

    return L.front_month(m, datetime.date(1997, 6, 15), wanted=segments)


@query("SELECT DISTINCT s_name AS symbol FROM supplier ANTI JOIN (SELECT l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1) USING (s_suppkey)")
def s15_unresolved_ids(spark, d):
    used = V.load(spark, d, "lineitem").filter("l_quantity > 49 AND l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    found = V.load(spark, d, "supplier").join(used, "s_suppkey", "left_semi").select(F.col("s_name").alias("symbol"))
    return L.unresolved(V.load(spark, d, "supplier").select(F.col("s_name").alias("symbol")), found)


def _frames(spark, d):
    """Each event as a depth packet of its symbol; every 50th frame is cut short, every 70th says a wrong length."""
    steps = lambda f: F.transform(F.sequence(F.lit(1), F.lit(20)), f)
    t = V.ticks(spark, d).select(
        "symbol",
        "seq",
        F.when(F.col("k") % 2 == 0, 41).otherwise(51).alias("code"),
        F.lit(2).alias("segment"),
        (1000 + F.col("user_id")).cast("int").alias("security_id"),
        F.col("seq").alias("sequence"),
        steps(lambda i: F.col("mid") - 0.05 * i).alias("price"),
        steps(lambda i: 100 * (1 + (F.col("k") + i) % 7)).alias("qty"),
        steps(lambda i: 1 + (F.col("user_id") + i) % 5).alias("orders"),
    )
    whole = P.depth_frames(t).select("symbol", "seq", "frame")
    two = F.concat("frame", F.substring("frame", 1, 332))  # the packet twice
    cut = F.when(F.col("seq") % 50 == 0, F.expr("substring(frame, 1, 328)")).when(F.col("seq") % 70 == 0, F.concat(F.unhex(F.lit("4B01")), F.expr("substring(frame, 3)")))
    return whole.withColumn("frame", F.coalesce(cut, F.when(F.col("seq") % 3 == 0, two).otherwise(F.col("frame"))))


@query(
    V.with_views("ticks")
    + f""", g AS (SELECT *, CASE WHEN seq % 50 = 0 THEN 'length 332 of code ' || CASE WHEN k % 2 = 0 THEN 41 ELSE 51 END || ' with 328 bytes left'
          WHEN seq % 70 = 0 THEN 'length 331 of code ' || CASE WHEN k % 2 = 0 THEN 41 ELSE 51 END || ' with 332 bytes left' END AS error FROM ticks)
    SELECT symbol, seq, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END END AS kind, CASE WHEN error IS NULL THEN 1000 + user_id END AS security_id, CASE WHEN error IS NULL THEN 'NSE_FNO' END AS segment,
        CASE WHEN error IS NULL THEN seq END AS sequence, CASE WHEN error IS NULL THEN list_sum(list_transform(range(1, 21), lambda i: 100 * (1 + (k + i) % 7)))::BIGINT END AS qty,
        CASE WHEN error IS NULL THEN list_sum(list_transform(range(1, 21), lambda i: 1 + (user_id + i) % 5))::BIGINT END AS orders, error,
        {rounded("CASE WHEN error IS NULL THEN mid - 0.05::DOUBLE END AS first_price", "CASE WHEN error IS NULL THEN mid - 0.05::DOUBLE * 20 END AS last_price")}
    FROM g, range(CASE WHEN error IS NULL AND seq % 3 = 0 THEN 2 ELSE 1 END)"""
)
def s18_wire_decode(spark, d):
    """Frames packed from the events and read again, beside those that can't be read with what is wrong with them."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    p = P.decoded(_frames(spark, d)).withColumns({"first_price": F.col("price")[0], "last_price": F.col("price")[19], "qty": total("qty"), "orders": total("orders")})
    return shown(p, ("symbol", "seq", "kind", "security_id", "segment", "sequence", "qty", "orders", "error"), "first_price", "last_price")
