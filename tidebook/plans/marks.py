"""Trades against the mid, live totals, attribution by hour, bars by minute, and orders over given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import evaluation as E
from tidebook.operators import marks as M
from tidebook.sources import depth as D
from tidebook.sources import views as V

from .features import _FEE
from .registry import query, rounded, shown
from .relations import _M, mids

#: Every tenth quote opens a trade at the bid, which ends half an hour later a tick better; quotes of events are minutes apart.
_TRIPS = (
    _M
    + f""", trips AS (SELECT symbol, date, ts, seq, ts + INTERVAL 1800 SECOND AS exit_ts, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction, bid AS entry_price, 550 AS qty,
        bid + (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * 0.25::DOUBLE AS exit_price FROM clean WHERE seq % 10 = 3),
    fees AS (SELECT *, qty * CASE WHEN direction > 0 THEN entry_price ELSE exit_price END AS buy, qty * CASE WHEN direction > 0 THEN exit_price ELSE entry_price END AS sell FROM trips),
    priced AS (SELECT *, {_FEE} AS fee FROM fees), closed AS (SELECT *, direction * (exit_price - entry_price) * qty - fee AS net_pnl FROM priced),
    targets AS (SELECT symbol, date, seq, 'exit' AS what, exit_ts AS at FROM closed UNION ALL SELECT symbol, date, seq, 'entry', ts FROM closed
        UNION ALL SELECT symbol, date, seq, 'm5', ts + INTERVAL 5 SECOND FROM closed UNION ALL SELECT symbol, date, seq, 'm30', ts + INTERVAL 30 SECOND FROM closed),
    hit AS (SELECT t.*, CASE WHEN t.at - m.ts <= INTERVAL 3600 SECOND THEN m.mid END AS mid FROM targets t ASOF LEFT JOIN m ON t.symbol = m.symbol AND t.date = m.date AND t.at >= m.ts),
    wide AS (SELECT symbol, date, seq, max(CASE WHEN what = 'entry' THEN mid END) AS mid_entry, max(CASE WHEN what = 'exit' THEN mid END) AS mid_exit, max(CASE WHEN what = 'm5' THEN mid END) AS m5,
        max(CASE WHEN what = 'm30' THEN mid END) AS m30 FROM hit GROUP BY ALL),
    marked AS (SELECT *, direction * (mid_exit - mid_entry) * qty - fee AS at_mid, direction * (m5 - entry_price) AS mk_5, direction * (m30 - entry_price) AS mk_30 FROM closed JOIN wide USING (symbol, date, seq)),
    totals AS (SELECT symbol, count(*) AS trades, sum(net_pnl) AS sim_net, coalesce(sum(at_mid), 0) AS mid_to_mid, avg(CASE WHEN at_mid > 0 THEN 1.0::DOUBLE ELSE 0 END) AS mid_win_rate,
        avg(mk_5 * qty) AS mk_5_rs, avg(mk_30 * qty) AS mk_30_rs, sum(net_pnl) - coalesce(sum(at_mid), 0) AS spread_capture FROM marked GROUP BY symbol)"""
)


def _trips(spark, d):
    side = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    t = mids(spark, d).filter("seq % 10 = 3").select("symbol", "date", "ts", "seq", (F.col("ts") + F.expr("INTERVAL 1800 SECONDS")).alias("exit_ts"), side.alias("direction"), F.col("bid").alias("entry_price"), F.lit(550).alias("qty"))
    t = t.withColumn("exit_price", F.col("entry_price") + F.col("direction") * 0.25)
    t = t.withColumn("fee", C.round_trip_fee(F.col("entry_price"), F.col("exit_price"), F.col("qty"), F.col("direction")))
    return t.withColumn("net_pnl", F.col("direction") * (F.col("exit_price") - F.col("entry_price")) * F.col("qty") - F.col("fee"))


def _mark_totals(spark, d):
    return M.mark_totals(M.trade_markouts(_trips(spark, d), mids(spark, d), (5, 30), tolerance_s=3600), "symbol", horizons_s=(5, 30))


@query(_TRIPS + f" SELECT symbol, trades, {rounded('sim_net', 'mid_to_mid', 'spread_capture', 'mk_5_rs', 'mk_30_rs', digits=3)}, {rounded('mid_win_rate')} FROM totals")
def g20_instrument_pnl(spark, d):
    """Of each instrument: trades, their result as told and at the mid, and the mean markout of a trade."""
    out = shown(_mark_totals(spark, d), ("symbol", "trades", "mid_win_rate"), "sim_net", "mid_to_mid", "spread_capture", "mk_5_rs", "mk_30_rs", digits=3)
    return out.withColumn("mid_win_rate", F.round("mid_win_rate", 6))


@query(_TRIPS + f" SELECT symbol, {rounded('i / 20 AS f', digits=2)}, {rounded('mid_to_mid + (i / 20) * spread_capture AS net', digits=3)}, {rounded('-mid_to_mid / spread_capture AS break_even', digits=6)} FROM totals, (SELECT unnest(range(21)) AS i)")
def g31_net_of_retention(spark, d):
    """The result of each instrument when a share f of the captured spread is kept."""
    n = M.net_of_retention(_mark_totals(spark, d))
    return n.select("symbol", F.round("f", 2).alias("f"), (F.round("net", 3) + 0.0).alias("net"), (F.round("break_even", 6) + 0.0).alias("break_even"))


@query(_TRIPS + f" SELECT hour(exit_ts + INTERVAL 330 MINUTE)::INT AS hour, count(*) AS n, {rounded('sum(net_pnl) AS net', 'avg(net_pnl) AS mean', digits=3)}, {rounded('avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate')} FROM closed GROUP BY ALL")
def g8_by_hour(spark, d):
    """Attribution by the hour of the exit on the exchange's clock."""
    g = _trips(spark, d).groupBy(F.hour(D.local_time("exit_ts")).alias("hour"))
    out = g.agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net"), F.avg("net_pnl").alias("mean"), F.avg(F.when(F.col("net_pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return shown(out, ("hour", "n", "win_rate"), "net", "mean", digits=3).withColumn("win_rate", F.round("win_rate", 6))


_NOW = "TIMESTAMP '1997-06-15 00:00:00'"


@query(
    V.with_views("trades")
    + f""", known AS (SELECT *, exit_ts > {_NOW} AS open FROM trades WHERE entry_ts <= {_NOW}),
    run AS (SELECT arm, net_pnl, sum(net_pnl) OVER (PARTITION BY arm ORDER BY exit_ts, order_key, line ROWS UNBOUNDED PRECEDING) AS r FROM known WHERE NOT open AND CAST(exit_ts AS DATE) = CAST({_NOW} AS DATE)),
    day AS (SELECT arm, sum(net_pnl) AS day_net, min(r) <= -2000 AS halted FROM run GROUP BY arm),
    g AS (SELECT arm, count(CASE WHEN NOT open THEN 1 END) AS n_trades, count(CASE WHEN open THEN 1 END) AS open_positions, sum(CASE WHEN open THEN 0 ELSE net_pnl END) AS realized, sum(CASE WHEN open THEN gross_pnl ELSE 0 END) AS unrealized,
      max(CASE WHEN open THEN entry_ts ELSE exit_ts END) AS last FROM known GROUP BY arm)
    SELECT arm, n_trades, open_positions, coalesce(halted, false) AS halted, epoch({_NOW})::BIGINT - epoch(CAST(last AS TIMESTAMP))::BIGINT AS feed_age_s,
      {rounded("realized", "unrealized", "realized + unrealized AS total", "coalesce(day_net, 0) AS day_net", digits=2)} FROM g LEFT JOIN day USING (arm)"""
)
def g29_telemetry_totals(spark, d):
    """Totals of the arms as a snapshot at one moment tells them: trades that are open then, the day's risk, the age of the feed."""
    g = M.telemetry_totals(V.trades(spark, d), F.lit("1997-06-15 00:00:00").cast("timestamp_ntz"), 2000.0, tie=("order_key", "line"))
    return shown(g, ("arm", "n_trades", "open_positions", "halted", "feed_age_s"), "realized", "unrealized", "total", "day_net", digits=2)


@query(V.with_views("ticks") + " SELECT symbol, epoch(date_trunc('minute', ts))::BIGINT AS minute, arg_max(mid, (ts, seq)) AS close, count(*) AS n FROM ticks WHERE mid > 0 GROUP BY symbol, date_trunc('minute', ts)")
def w11_minute_bars(spark, d):
    """The last clean mid of each minute; empty minutes are left out."""
    g = V.ticks(spark, d).filter("mid > 0").groupBy("symbol", F.date_trunc("minute", "ts").alias("m"))
    return g.agg(F.max_by("mid", F.struct("ts", "seq")).alias("close"), F.count("*").alias("n")).select("symbol", F.unix_timestamp(F.col("m").cast("timestamp")).alias("minute"), "close", "n")


@query(
    V.with_views("trades")
    + """, p AS (SELECT arm, underlying, exit_method, strftime(date, '%Y-%m') AS day, round(sum(net_pnl), 2) AS pnl FROM trades WHERE supp_key % 10 = 1 GROUP BY ALL),
    s AS (SELECT arm, underlying, exit_method, round(CASE WHEN count(pnl) >= 2 THEN avg(pnl) / (stddev_samp(pnl) + 1e-9::DOUBLE) * sqrt(252) END, 6) AS sharpe FROM p GROUP BY ALL)
    SELECT arm, underlying, exit_method, sharpe, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, arm, underlying, exit_method) AS place FROM s"""
)
def o1_grid_order(spark, d):
    """Settings of a grid in the order of their Sharpe ratio, those without one last. The rows are settings, so one task orders them."""
    t = V.trades(spark, d).filter("supp_key % 10 = 1").groupBy("arm", "underlying", "exit_method", F.date_format("date", "yyyy-MM").alias("day")).agg(F.round(F.sum("net_pnl"), 2).alias("pnl"))
    s = E.sharpe(t, "arm", "underlying", "exit_method", days=252).withColumn("sharpe", F.round("sharpe", 6))
    s = s.withColumn("sharpe", F.when(~F.isnan("sharpe"), F.col("sharpe")))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe"), "arm", "underlying", "exit_method")).cast("long"))


@query(
    V.with_views("ticks")
    + """, u AS (SELECT k % 3 AS arm, symbol, row_number() OVER (PARTITION BY k % 3 ORDER BY min((ts, seq))) AS i FROM ticks WHERE k % 3 < 2 OR seq % 2 = 0 GROUP BY k % 3, symbol),
    p AS (SELECT symbol, min((arm, i)) AS pos FROM u GROUP BY symbol) SELECT symbol, row_number() OVER (ORDER BY pos) AS place FROM p"""
)
def o9_ordered_union(spark, d):
    """Symbols of all arms in the order in which they are first named; an arm's universe is the order in which it first met them."""
    t = V.ticks(spark, d).filter("k % 3 < 2 OR seq % 2 = 0").groupBy((F.col("k") % 3).alias("arm"), "symbol").agg(F.min(F.struct("ts", "seq")).alias("at"))
    arms = t.groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]).alias("universe"))
    first = arms.select("arm", F.posexplode("universe").alias("j", "symbol")).groupBy("symbol").agg(F.min(F.struct("arm", "j")).alias("at"))
    return first.select("symbol", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))
