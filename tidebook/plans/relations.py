"""Joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import features as X
from tidebook.operators import joins as J
from tidebook.sources import views as V

from .features import W, frame
from .registry import query, rounded, shown

KEYS = ("symbol", "seq")


def mids(spark, d):
    return X.quote_columns(V.clean(V.quotes(spark, d)))


_M = V.with_views("clean") + ", m AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM clean)"


@query(_M + """ SELECT a.seq, round(a.mid, 6) + 0.0 AS mid_a, round(b.mid, 6) + 0.0 AS mid_b FROM (SELECT * FROM m WHERE symbol = 'click') a
    ASOF LEFT JOIN (SELECT * FROM m WHERE symbol = 'view') b ON a.date = b.date AND a.ts >= b.ts""")
def j1_asof_pair(spark, d):
    q = mids(spark, d).select("symbol", "date", "ts", "seq", "mid")
    a, b = q.filter("symbol = 'click'").withColumnRenamed("mid", "mid_a"), q.filter("symbol = 'view'").withColumnRenamed("mid", "mid_b")
    return shown(J.asof(a, b.drop("symbol"), keys=("date",)), ("seq",), "mid_a", "mid_b")


_FILLS = """, fills AS (SELECT symbol, date, ts, seq, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction, bid AS price FROM clean WHERE seq % 10 = 3),
    targets AS (SELECT f.*, h AS horizon, f.ts + to_seconds(h) AS at FROM fills f, (SELECT unnest([0, 60, 300, 1800]) AS h)),
    mk AS (SELECT t.symbol, t.seq, t.horizon, t.direction * (CASE WHEN t.at - m.ts <= INTERVAL 3600 SECOND THEN m.mid END - t.price) AS markout, t.direction, t.price
      FROM targets t ASOF LEFT JOIN m ON t.symbol = m.symbol AND t.date = m.date AND t.at >= m.ts)"""


def markouts(spark, d):
    q = mids(spark, d)
    fills = q.filter("seq % 10 = 3").select("symbol", "date", "ts", "seq", F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("bid").alias("price"))
    return J.markout(fills, q, (0, 60, 300, 1800), 3600)


@query(_M + _FILLS + f" SELECT symbol, seq, horizon, {rounded('markout')} FROM mk")
def j2_markout_asof(spark, d):
    return shown(markouts(spark, d), (*KEYS, "horizon"), "markout")


@query(_M + _FILLS + f" SELECT symbol, horizon, count(*) AS n, count(markout) AS n_priced, {rounded('avg(markout) AS per_share', 'sum(CASE WHEN markout > 0 THEN 1 ELSE 0 END) / count(*) AS win_rate')} FROM mk GROUP BY ALL")
def g19_markout_summary(spark, d):
    """A missing markout counts as no win."""
    g = markouts(spark, d).groupBy("symbol", "horizon")
    out = g.agg(F.count("*").alias("n"), F.count("markout").alias("n_priced"), F.avg("markout").alias("per_share"), F.avg(F.when(F.col("markout") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return shown(out, ("symbol", "horizon", "n", "n_priced"), "per_share", "win_rate")


@query(_M + """, feed AS (SELECT symbol, date, ts, k AS last_k FROM ticks WHERE k % 2 = 0)
    SELECT m.symbol, m.seq, f.last_k, coalesce(m.ts - f.ts > INTERVAL 1800 SECOND, true) AS stale FROM m ASOF LEFT JOIN feed f ON m.symbol = f.symbol AND m.date = f.date AND m.ts >= f.ts""")
def j3_stale_feed(spark, d):
    feed = V.ticks(spark, d).filter("k % 2 = 0").select("symbol", "date", "ts", "seq", F.col("k").alias("last_k"))
    found = J.asof(mids(spark, d).drop("k"), feed, source="feed_ts")
    old = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("feed_ts").cast("timestamp")) > 1_800_000_000
    return found.select(*KEYS, "last_k", F.coalesce(old, F.lit(True)).alias("stale"))


@query(_M + """, x AS (SELECT * FROM m WHERE symbol = 'click'), y AS (SELECT * FROM m WHERE symbol = 'error'),
    b AS (SELECT x.seq, x.ts, y.mid AS bm, y.ts AS bt FROM x ASOF LEFT JOIN y ON x.date = y.date AND x.ts >= y.ts),
    f AS (SELECT x.seq, y.mid AS fm, y.ts AS ft FROM x ASOF LEFT JOIN y ON x.date = y.date AND x.ts <= y.ts)
    SELECT seq, round(CASE WHEN ft IS NULL OR ts - bt <= ft - ts THEN bm ELSE fm END, 6) + 0.0 AS near FROM b JOIN f USING (seq)""")
def j3_nearest(spark, d):
    q = mids(spark, d)
    return shown(J.nearest(q.filter("symbol = 'click'").select("date", "ts", "seq"), q.filter("symbol = 'error'"), keys=("date",)), ("seq",), "near")


@query(V.with_views("trades") + """, depth AS (SELECT DISTINCT underlying, date FROM trades WHERE order_key % 40 = 0)
    SELECT underlying, count(*) AS n_unmatched FROM trades ANTI JOIN depth USING (underlying, date) GROUP BY ALL""")
def j4_unmatched_groups(spark, d):
    t = V.trades(spark, d)
    depth = t.filter("order_key % 40 = 0").select("underlying", "date")
    return J.unmatched(t, depth, ("underlying", "date")).groupBy("underlying").agg(F.sum("count").alias("n_unmatched"))


@query(V.with_views("trades") + f", days AS (SELECT DISTINCT date FROM trades WHERE extract(day FROM date) <= 12) SELECT arm, count(*) AS n, {rounded('sum(net_pnl) AS net', digits=2)} FROM trades SEMI JOIN days USING (date) GROUP BY arm")
def j5_clean_days(spark, d):
    t = V.trades(spark, d)
    days = t.select("date").filter(F.dayofmonth("date") <= 12).distinct()
    return shown(t.join(days, "date", "left_semi").groupBy("arm").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net")), ("arm", "n"), "net", digits=2)


@query(V.with_views("daily") + """, days AS (SELECT DISTINCT day FROM daily), arms AS (SELECT DISTINCT arm FROM daily)
    SELECT arm, day, coalesce(pnl, 0.0) AS pnl FROM days CROSS JOIN arms LEFT JOIN (SELECT * FROM daily WHERE day[7:7] <> '3') USING (arm, day)""")
def j6_calendar(spark, d):
    day = V.daily(spark, d)
    grid = day.select("day").distinct().crossJoin(day.select("arm").distinct())
    return grid.join(day.filter(F.substring("day", 7, 1) != "3"), ["arm", "day"], "left").select("arm", "day", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


SYMBOLS = ("click", "error", "purchase", "signup", "view")


@query(V.with_views("bars") + " SELECT epoch(hour)::BIGINT AS hour, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}" for s in SYMBOLS) + " FROM bars GROUP BY hour")
def j7_panel(spark, d):
    """Symbols side by side on the hour, outer-aligned."""
    b = V.bars(spark, d).withColumn("hour", F.unix_timestamp(F.col("hour").cast("timestamp")))
    return b.groupBy("hour").pivot("symbol", list(SYMBOLS)).agg(F.max("close"))


@query(V.with_views("bars") + " SELECT a.symbol AS x, b.symbol AS y, count(*) AS n FROM bars a JOIN bars b ON a.hour = b.hour AND a.symbol < b.symbol GROUP BY ALL")
def j8_pair_overlap(spark, d):
    b = V.bars(spark, d)
    x, y = b.select(F.col("symbol").alias("x"), "hour"), b.select(F.col("symbol").alias("y"), "hour")
    return x.join(y, "hour").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))


@query(V.with_views("ticks") + " SELECT a.symbol AS x, b.symbol AS y FROM (SELECT DISTINCT symbol FROM ticks) a JOIN (SELECT DISTINCT symbol FROM ticks) b ON a.symbol < b.symbol")
def j9_symbol_pairs(spark, d):
    s = V.ticks(spark, d).select("symbol").distinct()
    return s.select(F.col("symbol").alias("x")).join(s.select(F.col("symbol").alias("y")), F.expr("x < y"))


_SPLIT = """, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""


@query(V.with_views("bars") + _SPLIT + f" SELECT symbol, rn <= floor(n * 0.6) AS in_sample, count(*) AS n, {rounded('avg(close) AS mean')} FROM r GROUP BY ALL")
def j10_chronological_split(spark, d):
    b = V.bars(spark, d)
    w = Window.partitionBy("symbol")
    rn, n = F.row_number().over(w.orderBy("hour")), F.count("*").over(w)
    return shown(b.withColumn("in_sample", rn <= F.floor(n * 0.6)).groupBy("symbol", "in_sample").agg(F.count("*").alias("n"), F.avg("close").alias("mean")), ("symbol", "in_sample", "n"), "mean")


@query(V.with_views("trades") + f""", a AS (SELECT arm, sum(net_pnl) AS realized FROM trades WHERE arm <> '5-LOW' GROUP BY arm), b AS (SELECT arm, sum(net_pnl) AS live FROM trades WHERE arm <> '1-URGENT' AND line = 1 GROUP BY arm)
    SELECT arm, {rounded("coalesce(realized, 0) AS realized", "coalesce(live, 0) AS live", digits=2)}, live IS NOT NULL AS is_live FROM a FULL JOIN b USING (arm)""")
def j12_realized_with_live(spark, d):
    t = V.trades(spark, d)
    a = t.filter("arm <> '5-LOW'").groupBy("arm").agg(F.sum("net_pnl").alias("realized"))
    b = t.filter("arm <> '1-URGENT' AND line = 1").groupBy("arm").agg(F.sum("net_pnl").alias("live"))
    out = a.join(b, "arm", "full_outer").withColumn("is_live", F.col("live").isNotNull()).fillna(0.0, ["realized", "live"])
    return shown(out, ("arm", "is_live"), "realized", "live", digits=2)


ARMS = [("control", ["click", "view"]), ("expanded", list(SYMBOLS)), ("selective", ["purchase"])]
_ARMS = "arms AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {u})" for a, u in ARMS) + ") t(arm, universe))"


@query(V.with_views("clean") + f", {_ARMS} SELECT arm, symbol, count(*) AS n_packets FROM (SELECT arm, unnest(universe) AS symbol FROM arms) JOIN clean USING (symbol) GROUP BY ALL")
def j13_fan_out(spark, d):
    """Packets to the arms that trade their symbol; the arms are a fixed list."""
    arms = spark.createDataFrame(ARMS, "arm string, universe array<string>").select("arm", F.explode("universe").alias("symbol"))
    return V.clean(V.quotes(spark, d)).join(arms, "symbol").groupBy("arm", "symbol").agg(F.count("*").alias("n_packets"))


@query(V.with_views("ticks") + """, o AS (SELECT symbol, date, seq, CASE WHEN k % 3 = 0 THEN 'ask' ELSE 'bid' END AS side, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) AS rn FROM ticks),
    s AS (SELECT symbol, date, rn, CASE WHEN side = 'bid' THEN seq END AS b, CASE WHEN side = 'ask' THEN seq END AS a FROM o WHERE rn = 1
      UNION ALL SELECT o.symbol, o.date, o.rn,
        CASE WHEN o.side = 'bid' THEN o.seq WHEN s.a IS NOT NULL AND s.b IS NOT NULL THEN NULL ELSE s.b END,
        CASE WHEN o.side = 'ask' THEN o.seq WHEN s.a IS NOT NULL AND s.b IS NOT NULL THEN NULL ELSE s.a END
      FROM s JOIN o ON o.symbol = s.symbol AND o.date = s.date AND o.rn = s.rn + 1)
    SELECT symbol, date, b AS bid_seq, a AS ask_seq FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def j14_side_pairing(spark, d):
    return J.pair_sides(V.ticks(spark, d).withColumn("side", F.when(F.col("k") % 3 == 0, "ask").otherwise("bid")))


@query(V.with_views("trades") + ", g AS (SELECT t.threshold, s.stop FROM (SELECT unnest([0.5, 1.0, 2.0]) AS threshold) t, (SELECT unnest([4, 12]) AS stop) s) SELECT arm, threshold::DOUBLE AS threshold, stop, count(*) AS n FROM trades, g WHERE abs(net_pnl) / 1000 >= threshold::DOUBLE AND line <= stop GROUP BY ALL")
def j15_parameter_grid(spark, d):
    """Sessions against a fixed grid of parameters."""
    grid = spark.createDataFrame([(t, s) for t in (0.5, 1.0, 2.0) for s in (4, 12)], "threshold double, stop int")
    t = V.trades(spark, d).crossJoin(F.broadcast(grid))
    return t.filter((F.abs("net_pnl") / 1000 >= F.col("threshold")) & (F.col("line") <= F.col("stop"))).groupBy("arm", "threshold", "stop").agg(F.count("*").alias("n"))


@query(V.with_views("daily") + f" SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, {rounded('avg(a.pnl - b.pnl) AS mean_diff', 'avg(a.pnl - b.pnl) / (stddev_samp(a.pnl - b.pnl) / sqrt(count(*))) AS t', digits=4)} FROM daily a JOIN daily b ON a.day = b.day AND a.arm < b.arm GROUP BY ALL")
def j16_paired_difference(spark, d):
    day = V.daily(spark, d)
    a = day.select("day", F.col("arm").alias("arm_a"), F.col("pnl").alias("x"))
    b = day.select("day", F.col("arm").alias("arm_b"), F.col("pnl").alias("y"))
    diff = F.col("x") - F.col("y")
    g = a.join(b, "day").filter("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.try_divide(F.avg(diff), F.stddev_samp(diff) / F.sqrt(F.count("*"))).alias("t"))
    return shown(g, ("arm_a", "arm_b", "n"), "mean_diff", "t", digits=4)


@query("SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity > 45) USING (p_partkey)")
def j17_unresolved(spark, d):
    used = V.load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return V.load(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


# Windows


@query(V.with_views("ticks") + f" SELECT symbol, seq, {rounded(*[f'lag(mid, {n}) OVER {W} AS lag_{n}' for n in (1, 10)], f'lead(mid, 5) OVER {W} AS lead_5', f'coalesce(mid - lag(mid) OVER {W}, 0) AS move')} FROM ticks")
def w1_lag_lead(spark, d):
    w = C.session()
    t = V.ticks(spark, d).withColumns({"lag_1": F.lag("mid", 1).over(w), "lag_10": F.lag("mid", 10).over(w), "lead_5": F.lead("mid", 5).over(w), "move": F.coalesce(F.col("mid") - F.lag("mid").over(w), F.lit(0.0))})
    return shown(t, KEYS, "lag_1", "lag_10", "lead_5", "move")


@query(V.with_views("ticks") + f" SELECT symbol, seq, {rounded(f'sum(mid) OVER {W} AS cum', f'max(mid) OVER {W} AS peak', digits=4)} FROM ticks")
def w3_cumulative(spark, d):
    w = C.session().rowsBetween(Window.unboundedPreceding, 0)
    return shown(V.ticks(spark, d).withColumns({"cum": F.sum("mid").over(w), "peak": F.max("mid").over(w)}), KEYS, "cum", "peak", digits=4)


def _gate(e: str, n: int) -> str:
    return f"CASE WHEN count(mid) OVER {frame(n)} >= {n} THEN {e} OVER {frame(n)} END"


@query(V.with_views("ticks") + f" SELECT symbol, seq, {rounded(*[f'{_gate(f'{f}(mid)', 20)} AS {n}' for n, f in (('total', 'sum'), ('mean', 'avg'), ('low', 'min'), ('high', 'max'), ('sd', 'stddev_samp'))], digits=4)} FROM ticks")
def w4_rolling(spark, d):
    f = C.rolling(C.session(), 20)
    made = {n: C.gated(g("mid").over(f), F.col("mid"), f, 20) for n, g in (("total", F.sum), ("mean", F.avg), ("low", F.min), ("high", F.max), ("sd", F.stddev_samp))}
    return shown(V.ticks(spark, d).withColumns(made), KEYS, *made, digits=4)


@query(V.with_views("bars") + f""", p AS (SELECT a.symbol AS x, b.symbol AS y, a.hour, ln(a.close) AS la, ln(b.close) AS lb FROM bars a JOIN bars b ON a.hour = b.hour AND a.symbol < b.symbol),
    r AS (SELECT x, y, CASE WHEN count(*) OVER f >= 24 THEN covar_samp(la, lb) OVER f / var_samp(lb) OVER f END AS beta FROM p WINDOW f AS (PARTITION BY x, y ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT x, y, {rounded("avg(beta) AS mean_beta", "stddev_samp(beta) AS beta_drift", digits=5)} FROM r GROUP BY ALL""")
def w7_rolling_beta(spark, d):
    b = V.bars(spark, d)
    p = b.select(F.col("symbol").alias("x"), "hour", F.ln("close").alias("la")).join(b.select(F.col("symbol").alias("y"), "hour", F.ln("close").alias("lb")), "hour").filter("x < y")
    f = C.rolling(Window.partitionBy("x", "y").orderBy("hour"), 24)
    beta = F.when(F.count("*").over(f) >= 24, F.try_divide(F.covar_samp("la", "lb").over(f), F.var_samp("lb").over(f)))
    return shown(p.withColumn("beta", beta).groupBy("x", "y").agg(F.avg("beta").alias("mean_beta"), F.stddev_samp("beta").alias("beta_drift")), ("x", "y"), "mean_beta", "beta_drift", digits=5)


@query(V.with_views("ticks") + f", r AS (SELECT symbol, date, seq, mid, row_number() OVER {W} AS rn FROM ticks), b AS (SELECT symbol, date, (rn - 1) // 30 AS block, count(*) AS n, {rounded('avg(mid) AS mean')} FROM r GROUP BY ALL) SELECT symbol, date, block::BIGINT AS block, n, mean FROM b WHERE n >= 20")
def w10_packet_blocks(spark, d):
    """Blocks of 30 packets; a tail of fewer than 20 goes."""
    t = V.ticks(spark, d).withColumn("block", F.floor((F.row_number().over(C.session()) - 1) / 30))
    return shown(t.groupBy("symbol", "date", "block").agg(F.count("*").alias("n"), F.avg("mid").alias("mean")).filter("n >= 20"), ("symbol", "date", "block", "n"), "mean")


@query(V.with_views("bars") + " SELECT symbol, epoch(hour)::BIGINT AS hour, close FROM bars")
def w11_time_bars(spark, d):
    return V.bars(spark, d).select("symbol", F.unix_timestamp(F.col("hour").cast("timestamp")).alias("hour"), "close")


@query(V.with_views("clean") + " SELECT symbol, seq, rank() OVER (PARTITION BY symbol, date ORDER BY bid_qty) + (count(*) OVER (PARTITION BY symbol, date, bid_qty) - 1) / 2 AS mean_rank FROM clean")
def w12_mean_rank(spark, d):
    q = V.clean(V.quotes(spark, d))
    return q.select(*KEYS, C.mean_rank(["symbol", "date"], F.col("bid_qty")).alias("mean_rank"))


@query(V.with_views("ticks") + """, r AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
    SELECT symbol, seq FROM r WHERE n <= 240 OR i = n - 1 OR i = floor(floor(i * 240 / n + 0.999999) * n / 240)""".replace("floor(i * 240 / n + 0.999999)", "ceil(i * 240 / n)"))
def w14_even_thinning(spark, d):
    """At most 240 evenly spaced rows of each symbol, and its last one."""
    t = V.ticks(spark, d)
    days = t.groupBy("symbol", "date").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("symbol")
    # Rows are numbered within their day; what lies before follows from the days' counts.
    days = days.select("symbol", "date", (F.sum("rows").over(w.orderBy("date")) - F.col("rows")).alias("before"), F.sum("rows").over(w).alias("n"))
    r = t.join(days, ["symbol", "date"]).withColumn("i", F.col("before") + F.row_number().over(C.session()) - 1)
    hit = F.floor(F.ceil(F.col("i") * 240 / F.col("n")) * F.col("n") / 240)
    return r.filter((F.col("n") <= 240) | (F.col("i") == F.col("n") - 1) | (F.col("i") == hit)).select(*KEYS)


# Sorts and sets


@query(V.with_views("trades") + f", t AS (SELECT underlying, arm, sum(net_pnl) AS net FROM trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY net DESC, arm, underlying) AS rn FROM t) SELECT underlying, arm, {rounded('net', digits=2)} FROM r WHERE rn <= 5")
def o4_top_groups(spark, d):
    t = V.trades(spark, d).groupBy("underlying", "arm").agg(F.sum("net_pnl").alias("net"))
    return shown(t.orderBy(F.desc_nulls_last("net"), "arm", "underlying").limit(5), ("underlying", "arm"), "net", digits=2)


@query(V.with_views("daily") + " SELECT day, arg_min(arm, (-pnl, arm)) AS best FROM daily GROUP BY day")
def o5_best_arm(spark, d):
    """The arm with the greatest result of each day; of equal ones the first by name."""
    return V.daily(spark, d).groupBy("day").agg(F.min_by("arm", F.struct(-F.col("pnl"), "arm")).alias("best"))


@query("SELECT 'c' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 's', count(*), sum(s_suppkey)::BIGINT FROM supplier")
def o7_union_all(spark, d):
    c = V.load(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"))
    s = V.load(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders) WHERE a = 1 OR z = 1 GROUP BY o_custkey".replace("min(o_orderkey) AS first_order, max(o_orderkey) AS last_order", "max(CASE WHEN a = 1 THEN o_orderkey END) AS first_order, max(CASE WHEN z = 1 THEN o_orderkey END) AS last_order"))
def o8_first_and_last(spark, d):
    """De-duplication that keeps the first, and the last, row of a key in a fixed order."""
    at = F.struct("o_orderdate", "o_orderkey")
    return V.load(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"))


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def o10_set_operations(spark, d):
    c, s = V.load(spark, d, "customer").select("c_nationkey"), V.load(spark, d, "supplier")
    n = s.select(F.col("s_nationkey").alias("c_nationkey"))
    half = s.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    parts = {"both": c.intersect(n), "customers only": c.subtract(half), "any": c.union(n).distinct()}
    out = None
    for k, p in parts.items():
        row = p.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
