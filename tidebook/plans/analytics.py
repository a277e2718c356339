"""Trade analytics, information coefficients, data quality, and the overfitting statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import evaluation as E
from tidebook.operators import features as X
from tidebook.sources import views as V

from . import normal as N
from .features import W
from .registry import query, rounded, shown
from .relations import _FILLS, mids

SIGNALS, HORIZONS = ("micro_deviation", "obi_1", "ofi_l1"), (1, 5, 10)
T = V.with_views("trades")
D = V.with_views("daily")


def _ics(spark, d, least=50, keys=("symbol", "date")):
    """Sessions of the synthetic quotes are short, so a session here is a symbol's day."""
    q = X.forward(X.flow_first(X.microprice(mids(spark, d))), HORIZONS)
    half = F.when(F.hour("ts") < 12, "morning").otherwise("afternoon")
    return E.signal_ic(q.withColumn("half", half), SIGNALS, HORIZONS, keys=keys, least=least)


def _ic_sql(least: int, keys: str = "symbol, date") -> str:
    flow = (
        "CASE WHEN lag(bid) OVER w IS NULL THEN 0 ELSE (CASE WHEN bid > lag(bid) OVER w THEN bid_qty WHEN bid < lag(bid) OVER w THEN -lag(bid_qty) OVER w ELSE bid_qty - lag(bid_qty) OVER w END)"
        " - (CASE WHEN ask < lag(ask) OVER w THEN ask_qty WHEN ask > lag(ask) OVER w THEN -lag(ask_qty) OVER w ELSE ask_qty - lag(ask_qty) OVER w END) END"
    )
    fwd = ", ".join(f"lead(mid, {h}) OVER w / mid - 1 AS f{h}" for h in HORIZONS)
    return (
        V.with_views("clean")
        + f""", m AS (SELECT *, (bid + ask) / 2 AS mid FROM clean),
    s AS (SELECT symbol, date, ts, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'afternoon' END AS half, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) - (bid + ask) / 2 AS micro_deviation,
        (bid_qty - ask_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) AS obi_1, {flow} AS ofi_l1, {fwd} FROM m WINDOW w AS (PARTITION BY symbol, date ORDER BY ts, seq)),
    x AS ({" UNION ALL ".join(f"SELECT {keys}, '{g}' AS signal, {h} AS horizon, {g}::DOUBLE AS x, f{h} AS y FROM s" for g in SIGNALS for h in HORIZONS)}),
    r AS (SELECT {keys}, signal, horizon, rank() OVER (PARTITION BY {keys}, signal, horizon ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, signal, horizon, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY {keys}, signal, horizon ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, signal, horizon, y) - 1) / 2 AS ry
        FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
    ic AS (SELECT {keys}, signal, horizon, count(*) AS n, CASE WHEN count(*) >= {least} AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM r GROUP BY ALL)"""
    )


@query(_ic_sql(5) + f" SELECT symbol, horizon, count(*) AS n, {rounded('avg(ic) AS mean_ic')} FROM ic WHERE ic IS NOT NULL AND signal = 'micro_deviation' GROUP BY ALL")
def slice_ic(spark, d):
    """Quotes, garbage filter, micro-price, forward returns, and their rank correlation by symbol."""
    g = _ics(spark, d, 5).filter("ic IS NOT NULL AND signal = 'micro_deviation'").groupBy("symbol", "horizon")
    return shown(g.agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic")), ("symbol", "horizon", "n"), "mean_ic")


@query(_ic_sql(50) + f" SELECT symbol, date, signal, horizon, n, {rounded('ic')} FROM ic")
def g12_spearman_ic(spark, d):
    return shown(_ics(spark, d), ("symbol", "date", "signal", "horizon", "n"), "ic")


_SUMMARY = rounded("avg(ic) AS mean_ic", "stddev_samp(ic) AS std_ic", "avg(ic) / (stddev_samp(ic) + 1e-9::DOUBLE) AS icir", "avg(CASE WHEN ic > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS pct_pos", digits=5)


@query(_ic_sql(50) + f" SELECT signal, horizon, count(*) AS n, {_SUMMARY} FROM ic WHERE ic IS NOT NULL GROUP BY ALL")
def g13_ic_summary(spark, d):
    return shown(E.ic_summary(_ics(spark, d)), ("signal", "horizon", "n"), "mean_ic", "std_ic", "icir", "pct_pos", digits=5)


@query(_ic_sql(50) + f" SELECT symbol, signal, horizon, count(*) AS n, {_SUMMARY} FROM ic WHERE ic IS NOT NULL GROUP BY ALL")
def g14_ic_by_symbol(spark, d):
    return shown(E.ic_summary(_ics(spark, d), ("symbol", "signal", "horizon")), ("symbol", "signal", "horizon", "n"), "mean_ic", "std_ic", "icir", "pct_pos", digits=5)


@query(_ic_sql(50) + f" SELECT date, signal, count(*) AS n, {rounded('avg(ic) AS mean_ic', digits=5)} FROM ic WHERE ic IS NOT NULL AND horizon = 10 GROUP BY ALL")
def g14_ic_by_day(spark, d):
    """Mean IC of each day over its symbols, at ten packets."""
    g = _ics(spark, d).filter("ic IS NOT NULL AND horizon = 10").groupBy("date", "signal").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"))
    return shown(g, ("date", "signal", "n"), "mean_ic", digits=5)


@query(_ic_sql(20, "symbol, date, half") + f" SELECT signal, half, count(*) AS n, {rounded('avg(ic) AS mean_ic', digits=5)} FROM ic WHERE ic IS NOT NULL AND horizon = 10 GROUP BY ALL")
def g14_ic_by_half(spark, d):
    """The same of mornings and afternoons, the IC being that of the half session."""
    g = _ics(spark, d, 20, ("symbol", "date", "half")).filter("ic IS NOT NULL AND horizon = 10").groupBy("signal", "half").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"))
    return shown(g, ("signal", "half", "n"), "mean_ic", digits=5)


@query(_ic_sql(50) + " SELECT signal, " + ", ".join(f"round(avg(CASE WHEN horizon = {h} THEN ic END), 5) + 0.0 AS h{h}" for h in HORIZONS) + " FROM ic WHERE ic IS NOT NULL GROUP BY signal")
def g30_ic_pivot(spark, d):
    p = _ics(spark, d).filter("ic IS NOT NULL").groupBy("signal").pivot("horizon", list(HORIZONS)).agg(F.avg("ic"))
    return shown(p.withColumnsRenamed({str(h): f"h{h}" for h in HORIZONS}), ("signal",), *[f"h{h}" for h in HORIZONS], digits=5)


@query(_ic_sql(50) + ", s AS (SELECT signal, avg(ic) AS m FROM ic WHERE ic IS NOT NULL AND horizon = 10 GROUP BY signal) SELECT signal, row_number() OVER (ORDER BY abs(m) DESC, signal) AS place FROM s".replace(", s AS", ", z AS").replace("FROM s", "FROM z"))
def o2_by_absolute_ic(spark, d):
    s = _ics(spark, d).filter("ic IS NOT NULL AND horizon = 10").groupBy("signal").agg(F.avg("ic").alias("m"))
    return s.select("signal", F.row_number().over(Window.orderBy(F.desc(F.abs("m")), "signal")).cast("long").alias("place"))


@query(
    V.with_views("clean")
    + f""", m AS (SELECT symbol, date, seq, (bid + ask) / 2 AS a, ask - bid AS b, bid_qty::DOUBLE AS c, ask_qty::DOUBLE AS d FROM clean),
    r AS (SELECT symbol, date, {", ".join(f"rank() OVER (PARTITION BY symbol, date ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, date, {x}) - 1) / 2 AS {x}" for x in "abcd")} FROM m)
    SELECT symbol, date, {rounded(*[f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END AS {x}{y}" for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")], digits=5)} FROM r GROUP BY symbol, date"""
)
def g15_rank_correlation(spark, d):
    """Rank correlations of a session's columns, on all of its rows."""
    keys = ["symbol", "date"]
    m = mids(spark, d).select(*keys, F.col("mid").alias("a"), F.col("spread").alias("b"), F.col("bid_qty").alias("c"), F.col("ask_qty").alias("d"))
    r = m.select(*keys, *[C.mean_rank(keys, F.col(x)).alias(x) for x in "abcd"])
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    return shown(r.groupBy(*keys).agg(*[C.correlation(x, y).alias(x + y) for x, y in pairs]), tuple(keys), *[x + y for x, y in pairs], digits=5)


@query(D + f" SELECT a.arm AS arm_a, b.arm AS arm_b, {rounded('corr(a.pnl, b.pnl) AS r')} FROM daily a JOIN daily b ON a.day = b.day AND a.arm < b.arm GROUP BY ALL")
def g16_arm_correlation(spark, d):
    day = V.daily(spark, d)
    j = day.select("day", F.col("arm").alias("arm_a"), F.col("pnl").alias("x")).join(day.select("day", F.col("arm").alias("arm_b"), F.col("pnl").alias("y")), "day").filter("arm_a < arm_b")
    return shown(j.groupBy("arm_a", "arm_b").agg(C.correlation("x", "y").alias("r")), ("arm_a", "arm_b"), "r")


# Trades


@query(T + f" SELECT arm, date, {rounded('sum(net_pnl) AS pnl', digits=2)} FROM trades GROUP BY ALL")
def g1_daily_pnl(spark, d):
    return shown(V.trades(spark, d).groupBy("arm", "date").agg(F.sum("net_pnl").alias("pnl")), ("arm", "date"), "pnl", digits=2)


@query(
    T
    + f""" SELECT arm, count(*) AS n_trades, {rounded("sum(net_pnl) AS net", "sum(gross_pnl) AS gross", "sum(fee) AS fees", digits=2)}, {rounded("avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate",
    "CASE WHEN sum(CASE WHEN net_pnl < 0 THEN -net_pnl ELSE 0 END) > 0 THEN sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END) / sum(CASE WHEN net_pnl < 0 THEN -net_pnl ELSE 0 END) ELSE 'inf'::DOUBLE END AS profit_factor")} FROM trades GROUP BY arm"""
)
def g2_trade_metrics(spark, d):
    m = E.trade_metrics(V.trades(spark, d), "arm")
    money = shown(m, ("arm", "n_trades", "win_rate", "profit_factor"), "net", "gross", "fees", digits=2)
    return shown(money, ("arm", "n_trades", "net", "gross", "fees"), "win_rate", "profit_factor")


@query(D + f", c AS (SELECT arm, day, sum(pnl) OVER w AS cum FROM daily WINDOW w AS (PARTITION BY arm ORDER BY day)), p AS (SELECT arm, cum - max(cum) OVER (PARTITION BY arm ORDER BY day) AS dd FROM c) SELECT arm, {rounded('min(dd) AS max_drawdown', digits=2)} FROM p GROUP BY arm")
def g3_max_drawdown(spark, d):
    return shown(E.drawdown(V.daily(spark, d), "pnl", ("arm",), ("day",)), ("arm",), "max_drawdown", digits=2)


@query(D + f" SELECT arm, {rounded('CASE WHEN count(pnl) >= 2 THEN avg(pnl) / (stddev_samp(pnl) + 1e-9::DOUBLE) * sqrt(252) END AS sharpe')} FROM daily GROUP BY arm")
def g4_annual_sharpe(spark, d):
    return shown(E.sharpe(V.daily(spark, d), "arm", days=252), ("arm",), "sharpe")


@query(D + f" SELECT arm, {rounded('avg(pnl) / stddev_samp(pnl) AS sharpe')} FROM daily GROUP BY arm")
def g5_period_sharpe(spark, d):
    return shown(E.sharpe(V.daily(spark, d), "arm"), ("arm",), "sharpe")


@query(T + f" SELECT arm, exit_method, count(*) AS n, {rounded('avg(date_diff(' + chr(39) + 'day' + chr(39) + ', entry_ts, exit_ts)) AS avg_hold_days', digits=4)} FROM trades GROUP BY ALL")
def g6_holds_and_exits(spark, d):
    t = V.trades(spark, d).withColumn("hold", F.datediff(F.to_date("exit_ts"), F.to_date("entry_ts")))
    return shown(t.groupBy("arm", "exit_method").agg(F.count("*").alias("n"), F.avg("hold").alias("avg_hold_days")), ("arm", "exit_method", "n"), "avg_hold_days", digits=4)


@query(
    T
    + f""", g AS (SELECT 'underlying' AS kind, underlying AS name, net_pnl FROM trades UNION ALL SELECT 'exit', exit_method, net_pnl FROM trades UNION ALL SELECT 'month', strftime(date, '%m'), net_pnl FROM trades)
    SELECT kind, name, count(*) AS n, {rounded("sum(net_pnl) AS net", digits=2)}, {rounded("avg(net_pnl) AS mean", "avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate", digits=5)} FROM g GROUP BY ALL"""
)
def g8_attribution(spark, d):
    """By instrument, exit and month; one pass, the kinds made long."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("underlying", F.col("underlying")), ("exit", F.col("exit_method")), ("month", F.date_format("date", "MM")))])
    g = V.trades(spark, d).select("net_pnl", F.inline(kinds)).groupBy("kind", "name")
    out = g.agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net"), F.avg("net_pnl").alias("mean"), F.avg(F.when(F.col("net_pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return shown(shown(out, ("kind", "name", "n", "mean", "win_rate"), "net", digits=2), ("kind", "name", "n", "net"), "mean", "win_rate", digits=5)


@query(
    T
    + f""", a AS (SELECT arm, date, count(*) AS n, count(CASE WHEN net_pnl > 0 THEN 1 END) AS wins, count(CASE WHEN net_pnl <= 0 THEN 1 END) AS losses, sum(net_pnl) AS net, coalesce(avg(CASE WHEN net_pnl > 0 THEN net_pnl END), 0) AS w,
      coalesce(avg(CASE WHEN net_pnl <= 0 THEN net_pnl END), 0) AS l, max(net_pnl) AS best, min(net_pnl) AS worst FROM trades GROUP BY ALL)
    SELECT arm, date, n, wins, losses, {rounded("net", "best", "worst", digits=2)}, {rounded("w AS avg_win", "l AS avg_loss", "CASE WHEN l <> 0 THEN w / abs(l) ELSE 0 END AS payoff", digits=8)} FROM a"""
)
def g9_day_metrics(spark, d):
    m = E.day_metrics(V.trades(spark, d), "arm", "date")
    return shown(shown(m, ("arm", "date", "n", "wins", "losses", "avg_win", "avg_loss", "payoff"), "net", "best", "worst", digits=2), ("arm", "date", "n", "wins", "losses", "net", "best", "worst"), "avg_win", "avg_loss", "payoff", digits=8)


@query(T + f" SELECT arm, count(DISTINCT date) AS n_days, count(*) AS n_trades, {rounded('sum(net_pnl) AS total', digits=2)} FROM trades GROUP BY arm")
def g10_cumulative(spark, d):
    by_day = V.trades(spark, d).groupBy("arm", "date").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("s"))
    return shown(by_day.groupBy("arm").agg(F.count("*").alias("n_days"), F.sum("n").alias("n_trades"), F.sum("s").alias("total")), ("arm", "n_days", "n_trades"), "total", digits=2)


@query(T + f", m AS (SELECT arm, date, max(line) AS posts, max(line % 4) AS fills FROM trades GROUP BY ALL) SELECT arm, sum(posts)::BIGINT AS posts, sum(fills)::BIGINT AS fills, {rounded('sum(fills) / sum(posts) AS rate')} FROM m GROUP BY arm")
def g11_fill_rate(spark, d):
    """Counters run through a day, so their greatest value counts."""
    m = V.trades(spark, d).groupBy("arm", "date").agg(F.max("line").alias("posts"), F.max(F.col("line") % 4).alias("fills"))
    return shown(m.groupBy("arm").agg(F.sum("posts").alias("posts"), F.sum("fills").alias("fills"), F.try_divide(F.sum("fills"), F.sum("posts")).alias("rate")), ("arm", "posts", "fills"), "rate")


@query(D + f" SELECT arm, count(pnl) AS n, {rounded('skewness(pnl) AS skew', 'kurtosis(pnl) + 3 AS kurt', digits=5)} FROM daily GROUP BY arm")
def g17_moments(spark, d):
    return shown(E.moments(V.daily(spark, d), "arm"), ("arm", "n"), "skew", "kurt", digits=5)


@query(D + f" SELECT arm, {rounded('max(pnl) / sum(pnl) AS concentration', digits=5)}, {rounded('min(pnl) AS worst', digits=2)} FROM daily GROUP BY arm")
def g21_best_day(spark, d):
    m = V.daily(spark, d).groupBy("arm").agg(F.try_divide(F.max("pnl"), F.sum("pnl")).alias("concentration"), F.min("pnl").alias("worst"))
    return shown(shown(m, ("arm", "concentration"), "worst", digits=2), ("arm", "worst"), "concentration", digits=5)


@query(T + f", e AS (SELECT arm, avg(CASE WHEN exit_method = 'maker_exit' THEN net_pnl END) AS w, abs(avg(CASE WHEN exit_method <> 'maker_exit' THEN net_pnl END)) AS l FROM trades GROUP BY arm) SELECT arm, {rounded('l / (w + l) AS break_even', digits=5)} FROM e")
def g32_break_even_rate(spark, d):
    w = F.avg(F.when(F.col("exit_method") == "maker_exit", F.col("net_pnl")))
    loss = F.abs(F.avg(F.when(F.col("exit_method") != "maker_exit", F.col("net_pnl"))))
    return shown(V.trades(spark, d).groupBy("arm").agg(F.try_divide(loss, w + loss).alias("break_even")), ("arm",), "break_even", digits=5)


@query(T + f", s AS (SELECT underlying, sum(gross_pnl - fee) AS mid_to_mid, sum(abs(gross_pnl)) AS capture FROM trades GROUP BY underlying) SELECT underlying, {rounded('-mid_to_mid / capture AS retention', digits=5)} FROM s")
def g31_spread_retention(spark, d):
    """Share of the captured spread at which the result is 0."""
    s = V.trades(spark, d).groupBy("underlying").agg(F.sum(F.col("gross_pnl") - F.col("fee")).alias("m"), F.sum(F.abs("gross_pnl")).alias("c"))
    return shown(s.withColumn("retention", F.try_divide(-F.col("m"), F.col("c"))), ("underlying",), "retention", digits=5)


# Data quality


@query(V.with_views("quotes") + " SELECT symbol, count(*) - count(bid) AS null_bids, count(CASE WHEN bid <= 0 OR ask <= 0 THEN 1 END) AS zero_prices, count(CASE WHEN ask < bid THEN 1 END) AS crossed, count(DISTINCT k) AS codes FROM quotes GROUP BY symbol")
def g22_quality_counts(spark, d):
    q = V.quotes(spark, d)
    return q.groupBy("symbol").agg(F.count_if(F.col("bid").isNull()).alias("null_bids"), F.count_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("zero_prices"), F.count_if(F.col("ask") < F.col("bid")).alias("crossed"), F.countDistinct("k").alias("codes"))


@query(
    V.with_views("ticks")
    + f""", g AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER {W}) AS us FROM ticks)
    SELECT symbol, count(us) AS n, count(CASE WHEN us > 5000000 THEN 1 END) AS over_5s, {rounded("avg(us) / 1e3 AS mean_ms", "median(us) / 1e3 AS median_ms", "quantile_cont(us, 0.95) / 1e3 AS p95_ms", "quantile_cont(us, 0.99) / 1e3 AS p99_ms", "max(us) / 1e3 AS max_ms", digits=2)} FROM g GROUP BY symbol"""
)
def g23_gap_statistics(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = V.ticks(spark, d).select("symbol", (us - F.lag(us).over(C.session())).alias("us"))
    p = E.percentiles(g, ("symbol",), "us", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    out = g.groupBy("symbol").agg(F.count("us").alias("n"), F.count_if(F.col("us") > 5_000_000).alias("over_5s"), (F.avg("us") / 1e3).alias("mean_ms"), (F.max("us") / 1e3).alias("max_ms"))
    out = out.join(p, "symbol", "left").withColumns({f"{c}_ms": F.col(c) / 1e3 for c in ("median", "p95", "p99")})
    return shown(out, ("symbol", "n", "over_5s"), "mean_ms", "median_ms", "p95_ms", "p99_ms", "max_ms", digits=2)


@query(
    V.with_views("book")
    + f""", l AS (SELECT symbol, unnest(range(1, 21))::INT AS level, unnest(bid_qty) AS q, unnest(bid_orders) AS o FROM book)
    SELECT symbol, level, {rounded("avg(q) AS mean_qty", "avg(o) AS mean_orders", "avg(q / greatest(o, 1)) AS mean_size", digits=5)} FROM l GROUP BY ALL"""
)
def g24_depth_profile(spark, d):
    l = V.book(spark, d).select("symbol", F.posexplode(F.arrays_zip(F.col("bid_qty").alias("q"), F.col("bid_orders").alias("o"))).alias("i", "x"))  # noqa: E741
    g = l.groupBy("symbol", (F.col("i") + 1).alias("level")).agg(F.avg("x.q").alias("mean_qty"), F.avg("x.o").alias("mean_orders"), F.avg(F.col("x.q") / F.greatest(F.col("x.o"), F.lit(1))).alias("mean_size"))
    return shown(g, ("symbol", "level"), "mean_qty", "mean_orders", "mean_size", digits=5)


@query(
    V.with_views("clean")
    + f""", l AS (SELECT symbol, ln(ask - bid) AS x FROM clean WHERE ask > bid), f AS (SELECT symbol, avg(x) AS mu, stddev_pop(x) AS sigma FROM l GROUP BY symbol)
    SELECT symbol, {rounded("any_value(mu) AS mu", "any_value(sigma) AS sigma", "avg(CASE WHEN abs((x - mu) / sigma) > 2 THEN 1.0::DOUBLE ELSE 0 END) AS beyond_two", digits=5)} FROM l JOIN f USING (symbol) GROUP BY symbol"""
)
def g25_log_normal_spread(spark, d):
    l = mids(spark, d).filter("spread > 0").select("symbol", F.ln("spread").alias("x"))  # noqa: E741
    f = l.groupBy("symbol").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
    j = l.join(f, "symbol").groupBy("symbol", "mu", "sigma").agg(F.avg(F.when(F.abs(F.try_divide(F.col("x") - F.col("mu"), F.col("sigma"))) > 2, 1.0).otherwise(0.0)).alias("beyond_two"))
    return shown(j, ("symbol",), "mu", "sigma", "beyond_two", digits=5)


@query(
    V.with_views("clean")
    + f""", m AS (SELECT symbol, date, (bid + ask) / 2 AS mid, ask - bid AS spread FROM clean), p AS (SELECT symbol, date, count(*) AS n, median(spread) AS ms, median(mid) AS mm FROM m GROUP BY ALL)
    SELECT symbol, count(*) AS n_days, sum(n)::BIGINT AS n, min(date) AS first, max(date) AS last, {rounded("median(ms) AS median_spread", "median(mm) AS median_mid", digits=5)} FROM p GROUP BY symbol"""
)
def g27_coverage(spark, d):
    """The median of the days' median spreads."""
    p = mids(spark, d).groupBy("symbol", "date").agg(F.count("*").alias("n"), F.median("spread").alias("ms"), F.median("mid").alias("mm"))
    g = p.groupBy("symbol").agg(F.count("*").alias("n_days"), F.sum("n").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.median("ms").alias("median_spread"), F.median("mm").alias("median_mid"))
    return shown(g, ("symbol", "n_days", "n", "first", "last"), "median_spread", "median_mid", digits=5)


@query(V.with_views("bars") + f" SELECT symbol, epoch(hour)::BIGINT AS hour, {rounded('close / first_value(close) OVER (PARTITION BY symbol ORDER BY hour) AS normal', digits=5)} FROM bars")
def g28_normalised(spark, d):
    b = V.bars(spark, d).withColumn("normal", F.col("close") / F.first("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("hour")))
    return shown(b.withColumn("hour", F.unix_timestamp(F.col("hour").cast("timestamp"))), ("symbol", "hour"), "normal", digits=5)


# Overfitting statistics

_AC = D + ", m AS (SELECT arm, day, pnl - avg(pnl) OVER (PARTITION BY arm) AS x, row_number() OVER (PARTITION BY arm ORDER BY day) AS i FROM daily), v AS (SELECT arm, count(*) AS n, var_pop(pnl) AS v FROM daily GROUP BY arm), r AS (SELECT a.arm, b.i - a.i AS lag, any_value(n) AS n, sum(a.x * b.x) / (any_value(n) * any_value(v)) AS rho FROM m a JOIN m b ON a.arm = b.arm AND b.i > a.i AND b.i <= a.i + 60 JOIN v ON a.arm = v.arm GROUP BY ALL)"


@query(_AC + f" SELECT arm, lag::INT AS lag, {rounded('rho')} FROM r WHERE lag <= 5")
def u1_autocorrelation(spark, d):
    return shown(E.autocorrelation(V.daily(spark, d), "pnl", ("arm",), ("day",), 5), ("arm", "lag"), "rho")


@query(_AC + f", e AS (SELECT arm, min(CASE WHEN rho <= 0 THEN lag END) AS stop FROM r WHERE lag <= least(n - 1, floor(10 * log10(n)) + 20) GROUP BY arm) SELECT v.arm, v.n, {rounded('v.n / (1 + 2 * coalesce((SELECT sum(rho) FROM r WHERE r.arm = v.arm AND lag <= least(v.n - 1, floor(10 * log10(v.n)) + 20) AND lag < coalesce(stop, 1000)), 0)) AS n_eff', digits=5)} FROM v JOIN e USING (arm)")
def u2_effective_size(spark, d):
    return shown(E.effective_size(V.daily(spark, d), "pnl", ("arm",), ("day",)), ("arm", "n"), "n_eff", digits=5)


_MOMENTS = """, mo AS (SELECT {arm} AS arm, count({value}) AS n, count(CASE WHEN {value} <> 0 THEN 1 END) AS n_days, CASE WHEN stddev_samp({value}) > 0 THEN avg({value}) / stddev_samp({value}) ELSE 0 END AS sharpe,
      CASE WHEN count({value}) > 2 THEN skewness({value}) END AS skew, CASE WHEN count({value}) > 3 THEN kurtosis({value}) + 3 END AS kurt FROM {source} GROUP BY ALL),
    tr AS (SELECT CASE WHEN count(*) = 1 THEN abs(max(sharpe)) / sqrt(2) ELSE stddev_samp(sharpe) END AS sd, greatest(count(*), 2)::DOUBLE AS k FROM mo),
    ti AS (SELECT sd, 1 - 1 / k AS p1, 1 - 1 / (k * 2.718281828459045::DOUBLE) AS p2 FROM tr),
    st AS (SELECT CASE WHEN sd > 0 THEN sd * ((1 - 0.5772156649015329::DOUBLE) * {first} + 0.5772156649015329::DOUBLE * {second}) ELSE 0 END AS sr_star FROM ti),
    sp0 AS (SELECT mo.*, sr_star, {plain} AS v0, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS v1 FROM mo, st),
    zz AS (SELECT *, CASE WHEN {n} >= 2 AND v0 > 0 THEN sharpe * sqrt({n} - 1) / sqrt(v0) END AS z0, CASE WHEN {n} >= 2 AND v1 > 0 THEN (sharpe - sr_star) * sqrt({n} - 1) / sqrt(v1) END AS z1 FROM sp0),
    df AS (SELECT *, {cdf0} AS psr, {cdf1} AS dsr FROM zz)"""


def deflated_sql(source: str, arm: str = "arm", value: str = "pnl", every_day: bool = False, normal: bool = False) -> str:
    """CTEs up to df, the rows of evaluation.deflated."""
    plain = "1 + 0.5::DOUBLE * sharpe * sharpe" if normal else "1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe"
    return _MOMENTS.format(source=source, arm=arm, value=value, n="n" if every_day else "n_days", plain=plain, first=N.ppf("p1"), second=N.ppf("p2"), cdf0=N.cdf("z0"), cdf1=N.cdf("z1"))


@query(D + deflated_sql("daily") + f" SELECT arm, n, n_days, {rounded('sharpe', 'skew', 'kurt', 'psr', 'sr_star', 'dsr')} FROM df")
def u6_deflated_sharpe(spark, d):
    """PSR against 0 and against the best of the arms without skill (U3 to U6)."""
    return shown(E.deflated(V.daily(spark, d)), ("arm", "n", "n_days"), "sharpe", "skew", "kurt", "psr", "sr_star", "dsr")


@query(D + N.overfit("daily") + f" SELECT n_splits, {rounded('pbo', 'median_logit', digits=5)} FROM pb")
def u7_pbo(spark, d):
    return shown(E.pbo(V.kept_daily(spark, d)), ("n_splits",), "pbo", "median_logit", digits=5)


def _diffs(day):
    base = day.filter("arm = '1-URGENT'").select("day", F.col("pnl").alias("base"))
    return day.filter("arm <> '1-URGENT'").join(base, "day").select("arm", "day", (F.col("pnl") - F.col("base")).alias("diff"))


_DIFFS = ", di AS (SELECT a.arm, a.day, a.pnl - b.pnl AS diff FROM daily a JOIN daily b ON a.day = b.day AND b.arm = '1-URGENT' WHERE a.arm <> '1-URGENT')"
_DRAWS = 10_000


@query(
    D
    + _DIFFS
    + N.resampled("di", "diff", _DRAWS, 1, "mean")
    + f" SELECT arm, n, {rounded('mean', 't', 'low', 'high', 'p_gt0', digits=4)} FROM (SELECT arm, count(*) AS n, avg(diff) AS mean, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM di GROUP BY arm) JOIN bs USING (arm)"
)
def u8_paired_bootstrap(spark, d):
    return shown(E.bootstrap(_diffs(V.kept_daily(spark, d)), ("arm",), "diff", "day", _DRAWS), ("arm", "n"), "mean", "t", "low", "high", "p_gt0", digits=4)


@query(
    D
    + N.resampled("daily", "pnl", _DRAWS, 2, "sharpe")
    + f" SELECT arm, n, {rounded('sharpe', 'low', 'high', digits=4)} FROM (SELECT arm, count(*) AS n, CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END AS sharpe FROM daily GROUP BY arm) JOIN bs USING (arm)"
)
def u9_block_bootstrap(spark, d):
    """The interval of the Sharpe per day, from circular blocks of two days."""
    return shown(E.bootstrap(V.daily(spark, d), ("arm",), "pnl", "day", _DRAWS, 2, statistic="sharpe"), ("arm", "n"), "sharpe", "low", "high", digits=4)


_REPORT = (
    D
    + deflated_sql("daily")
    + N.overfit("daily")
    + _DIFFS
    + N.resampled("di", "diff", _DRAWS, 1, "mean")
    + """, ov AS (SELECT arm, sum(pnl) AS total, avg(pnl) AS mean_day, stddev_samp(pnl) AS std_day, min(pnl) AS worst, max(pnl) AS best, max(pnl) / sum(pnl) AS concentration FROM daily GROUP BY arm),
    tm AS (SELECT arm, count(*) AS trades, avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate FROM trades GROUP BY arm),
    co AS (SELECT a.arm, corr(a.pnl, b.pnl) AS base_corr FROM daily a JOIN daily b ON a.day = b.day AND b.arm = '1-URGENT' GROUP BY a.arm)
    SELECT df.arm, trades, n_days, CASE WHEN low > 0 THEN 'real' WHEN high < 0 THEN 'worse' WHEN low IS NOT NULL THEN 'inconclusive' END AS verdict, """
    + rounded("total", "mean_day", "std_day", "sharpe", "skew", "kurt", "worst", "best", "win_rate", "psr", "dsr", "concentration", "base_corr", "(SELECT pbo FROM pb) AS pbo", digits=6)
    + " FROM df JOIN ov USING (arm) JOIN tm USING (arm) LEFT JOIN co USING (arm) LEFT JOIN bs USING (arm)"
)


@query(_REPORT)
def u10_arm_report(spark, d):
    """Each arm's statistics, its correlation with the base arm, the share of its best day, the arms' PBO, and a verdict.

    The verdict is the sign of the interval of the difference from the base arm.
    """
    kept, x = V.kept_daily(spark, d), F.col("pnl")
    daily = kept.select("arm", "day", "pnl")
    over = daily.groupBy("arm").agg(F.sum(x).alias("total"), F.avg(x).alias("mean_day"), F.stddev_samp(x).alias("std_day"), F.min(x).alias("worst"), F.max(x).alias("best"), F.try_divide(F.max(x), F.sum(x)).alias("concentration"))
    trades = kept.groupBy("arm").agg(F.sum("trades").alias("trades"), (F.sum("wins") / F.sum("trades")).alias("win_rate"))
    base = daily.filter("arm = '1-URGENT'").select("day", x.alias("base"))
    corr = daily.join(base, "day").groupBy("arm").agg(C.correlation("pnl", "base").alias("base_corr"))
    diff = E.bootstrap(_diffs(daily), ("arm",), "diff", "day", _DRAWS).select("arm", "low", "high")
    out = E.deflated(daily).join(over, "arm").join(trades, "arm").join(corr, "arm", "left").join(diff, "arm", "left").crossJoin(F.broadcast(E.pbo(daily).select("pbo")))
    out = out.withColumn("verdict", F.when(F.col("low") > 0, "real").when(F.col("high") < 0, "worse").when(F.col("low").isNotNull(), "inconclusive"))
    columns = ("total", "mean_day", "std_day", "sharpe", "skew", "kurt", "worst", "best", "win_rate", "psr", "dsr", "concentration", "base_corr", "pbo")
    return shown(out, ("arm", "trades", "n_days", "verdict"), *columns, digits=6)


# Further reports


@query(
    V.with_views("clean")
    + """, m AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM clean)"""
    + _FILLS
    + f""" SELECT symbol, count(DISTINCT seq) AS fills, {rounded(*[f"avg(CASE WHEN horizon = {h} THEN markout END) AS at_{h}s" for h in (0, 300, 1800)], digits=6)} FROM mk GROUP BY symbol"""
)
def g20_instrument_markout(spark, d):
    from .relations import markouts

    g = markouts(spark, d).groupBy("symbol").agg(F.countDistinct("seq").alias("fills"), *[F.avg(F.when(F.col("horizon") == h, F.col("markout"))).alias(f"at_{h}s") for h in (0, 300, 1800)])
    return shown(g, ("symbol", "fills"), "at_0s", "at_300s", "at_1800s")


@query(
    V.with_views("clean")
    + """, l AS (SELECT symbol, date, seq, ln(ask - bid) AS x FROM clean WHERE ask - bid > 0),
    o AS (SELECT symbol, date, x, count(*) OVER (PARTITION BY symbol, date) AS n, row_number() OVER (PARTITION BY symbol, date ORDER BY x, seq) AS i FROM l),
    p AS (SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o WHERE n >= 3),
    q AS (SELECT *, """
    + N.ppf("p")
    + f" AS q FROM p) SELECT symbol, date, count(*) AS n, {rounded('regr_slope(x, q) AS slope', 'regr_intercept(x, q) AS intercept', 'regr_r2(x, q) AS r2', digits=4)} FROM q GROUP BY symbol, date"
)
def g26_normal_plot(spark, d):
    """Fit of the ordered log spreads to normal order-statistic medians, a session at a time."""
    s = mids(spark, d).filter("spread > 0").select("symbol", "date", "seq", F.ln("spread").alias("x"))
    w = Window.partitionBy("symbol", "date")
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("x", "seq"))
    end = F.pow(F.lit(0.5), 1 / n)
    place = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    q = s.withColumns({"p": place, "n": n}).filter("n >= 3").withColumn("q", C.normal_ppf(F.col("p")))
    return shown(q.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.regr_slope("x", "q").alias("slope"), F.regr_intercept("x", "q").alias("intercept"), F.regr_r2("x", "q").alias("r2")), ("symbol", "date", "n"), "slope", "intercept", "r2", digits=4)


@query(T + """, m AS (SELECT arm, to_json({'n': count(*), 'wins': count(CASE WHEN net_pnl > 0 THEN 1 END)}) AS j FROM trades GROUP BY arm) SELECT arm, CAST(json_extract(j, '$.n') AS BIGINT) AS n, CAST(json_extract(j, '$.wins') AS BIGINT) AS wins FROM m""")
def s22_report_json(spark, d):
    """Report rows through JSON and back, as the monitor reads them."""
    m = V.trades(spark, d).groupBy("arm").agg(F.to_json(F.struct(F.count("*").alias("n"), F.count_if(F.col("net_pnl") > 0).alias("wins"))).alias("j"))
    return m.select("arm", F.from_json("j", "n long, wins long").alias("r")).select("arm", "r.n", "r.wins")


@query(V.with_views("quotes") + f", n AS (SELECT symbol, seq, count(*) OVER (PARTITION BY symbol, date) AS n FROM quotes) SELECT symbol, seq FROM n WHERE ({N.drawn("'42-' || symbol || '-' || seq")} % 1000000) * n < 20 * 1000000")
def o11_bounded_sample(spark, d):
    """About 20 rows of each session, chosen by a hash of the row, for plots."""
    n = F.count("*").over(Window.partitionBy("symbol", "date"))
    draw = C.drawn(F.concat_ws("-", F.lit(42), "symbol", "seq")) % 1_000_000
    return V.quotes(spark, d).withColumn("n", n).filter(draw * F.col("n") < 20 * 1_000_000).select("symbol", "seq")


# Signals that the reference only describes


@query(
    V.with_views("ticks")
    + f""", v AS (SELECT symbol, date, seq, mid, sum(mid * (1 + k)) OVER {W} / sum(1 + k) OVER {W} AS vwap FROM ticks) SELECT symbol, seq, {rounded("(mid - vwap) / vwap * 1e4 AS vwap_dev_bps", digits=3)} FROM v"""
)
def a8_vwap_deviation(spark, d):
    """Distance from the session's volume-weighted price so far, in basis points."""
    w = C.session().rowsBetween(Window.unboundedPreceding, 0)
    vol = 1 + F.col("k")
    vwap = F.sum(F.col("mid") * vol).over(w) / F.sum(vol).over(w)
    return shown(V.ticks(spark, d).withColumn("vwap_dev_bps", (F.col("mid") - vwap) / vwap * 1e4), ("symbol", "seq"), "vwap_dev_bps", digits=3)


@query(
    V.with_views("clean")
    + """, s AS (SELECT symbol, seq, ask - bid AS spread, avg(ask - bid) OVER f AS mean, count(*) OVER f AS n FROM clean WINDOW f AS (PARTITION BY symbol, date ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, seq FROM s WHERE n = 20 AND spread > 1.5::DOUBLE * mean + 1e-9::DOUBLE"""
)
def a10_spread_breakout(spark, d):
    """Packets whose spread is more than half again the mean of the twenty before."""
    f = C.session().rowsBetween(-20, -1)
    s = mids(spark, d).withColumns({"mean": F.avg("spread").over(f), "n": F.count("*").over(f)})
    return s.filter((F.col("n") == 20) & (F.col("spread") > 1.5 * F.col("mean") + 1e-9)).select("symbol", "seq")


@query(
    V.with_views("bars")
    + f""", r AS (SELECT symbol, hour, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY hour)) AS r FROM bars)
    SELECT a.symbol AS leader, b.symbol AS follower, count(*) AS n, {rounded("corr(a.r, b.r) AS lead_corr", digits=5)} FROM r a JOIN r b ON b.hour = a.hour + INTERVAL 1 HOUR AND a.symbol <> b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL"""
)
def a12_lead_lag(spark, d):
    """Correlation of a symbol's return with another's an hour later."""
    b = V.bars(spark, d)
    r = b.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy("symbol").orderBy("hour")))).filter("r IS NOT NULL")
    lead = r.select(F.col("symbol").alias("leader"), (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.col("r").alias("x"))
    j = lead.join(r.select(F.col("symbol").alias("follower"), "hour", F.col("r").alias("y")), "hour").filter("leader <> follower")
    return shown(j.groupBy("leader", "follower").agg(F.count("*").alias("n"), C.correlation("x", "y").alias("lead_corr")), ("leader", "follower", "n"), "lead_corr", digits=5)
