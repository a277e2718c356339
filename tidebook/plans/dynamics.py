"""Smoothing, filters, regimes and pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import features as X
from tidebook.operators import recurrences as R
from tidebook.operators import regime as G
from tidebook.operators import scans as S
from tidebook.sources import views as V

from .analytics import deflated_sql
from .features import _A5, _A6, _BEFORE, _MICRO, _OFI, _RAW, _RESONANCE, _SUMS_W, KEYS, W, _flow, _lag, _z, leg_costs, resonances
from . import normal as N
from .registry import ORACLE, query, rounded, shown
from .relations import mids


#: Six hours, in microseconds: a session of the synthetic quotes lasts a day.
CHUNK = 6 * 3600 * 1_000_000


def ema_sql(source: str, value: str, alpha: float) -> str:
    """CTEs o, e: the exponential mean y of `value` over the sessions of `source`; weights decay over nulls."""
    a = f"{alpha!r}::DOUBLE"
    return f"""o AS (SELECT symbol, date, seq, ({value})::DOUBLE AS x, row_number() OVER {W} AS rn FROM {source}),
    e AS (SELECT symbol, date, seq, rn, x AS y, 1.0::DOUBLE AS wt FROM o WHERE rn = 1
      UNION ALL SELECT o.symbol, o.date, o.seq, o.rn,
        CASE WHEN e.y IS NULL THEN o.x WHEN o.x IS NULL THEN e.y ELSE (e.wt * (1 - {a}) * e.y + {a} * o.x) / (e.wt * (1 - {a}) + {a}) END,
        CASE WHEN o.x IS NULL AND e.y IS NOT NULL THEN e.wt * (1 - {a}) ELSE 1.0 END
      FROM e JOIN o ON o.symbol = e.symbol AND o.date = e.date AND o.rn = e.rn + 1)"""


@query(V.with_views("clean") + ", m AS (SELECT *, (bid + ask) / 2 AS mid FROM clean), " + ema_sql("m", "mid", 2 / 33) + f" SELECT symbol, seq, {rounded('y AS ema', digits=7)} FROM e")
def w6_ema(spark, d):
    """By chunks of six hours of each session."""
    return shown(S.ema_scan(mids(spark, d).select("symbol", "date", "ts", "seq", "mid"), "mid", "ema", 2 / 33, CHUNK), KEYS, "ema", digits=7)


@query(V.with_views("book") + ", s AS (SELECT *, " + _SUMS_W[0] + " FROM book), k AS (SELECT *, " + _SUMS_W[1] + " AS brk FROM s), " + ema_sql("k", "brk", 0.05) + f" SELECT symbol, seq, {rounded('y AS a3_symmetry_break_ema', digits=5)} FROM e")
def p8_a3_smoothed(spark, d):
    df = X.symmetry(V.book(spark, d)).select("symbol", "date", "ts", "seq", "a3_symmetry_break")
    return shown(R.ema(df, "a3_symmetry_break", "a3_symmetry_break_ema", alpha=0.05), KEYS, "a3_symmetry_break_ema", digits=5)


def _book_features(spark, d):
    return X.impact_depth(X.activation(X.mid_of_book(V.book(spark, d)), F.lit(120)), F.lit(800))


@query(V.with_views("book") + f", {_A5}, {_A6}, r AS (SELECT *, vb5 - va5 AS sig FROM a6), c AS (SELECT *, {_RAW} AS raw FROM r), " + ema_sql("c", "raw", 2 / 101) + f" SELECT symbol, seq, {rounded('y AS composite_eq', digits=4)} FROM e")
def p20_composite(spark, d):
    df = X.composite(_book_features(spark, d)).select("symbol", "date", "ts", "seq", "composite_raw")
    return shown(R.ema(df, "composite_raw", "composite_eq", span=100), KEYS, "composite_eq", digits=4)


_MB = "(bid_price[1] * ask_qty[1] + ask_price[1] * bid_qty[1]) / (bid_qty[1] + ask_qty[1] + 1e-9::DOUBLE) - (bid_price[1] + ask_price[1]) / 2"


_FLOW_RAW = (
    V.with_views("book")
    + f", {_A5}, {_A6}, l AS (SELECT *, {_BEFORE}, row_number() OVER {W} AS rn FROM a6), f AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE {_OFI} END AS ofi, {_MB} AS md FROM l),"
    + f" c AS (SELECT * EXCLUDE (rn), 3 * ({_z('md', 100, 20)}) + {_z('ofi', 100, 20)} + {_z('va6', 100, 20)} - {_z('vb6', 100, 20)} AS raw FROM f)"
)


@query(_FLOW_RAW + ", " + ema_sql("c", "raw", 2 / 101) + f" SELECT symbol, seq, {rounded('y AS flow_eq', digits=4)} FROM e")
def p22_flow_composite(spark, d):
    df = X.flow_composite(X.flow_levels(X.microprice(_book_features(spark, d)))).select("symbol", "date", "ts", "seq", "flow_raw")
    return shown(R.ema(df, "flow_raw", "flow_eq", span=100), KEYS, "flow_eq", digits=4)


@query(
    V.with_views("book")
    + f""", {_RESONANCE}, rs AS (SELECT 'S0' AS symbol, date, ts, seq, (rb + ra) / 2 AS res FROM r), rz AS (SELECT *, {_z("res", 200, 10)} AS z FROM rs), """
    + ema_sql("rz", "res", 0.1)
    + f" SELECT e.seq, {rounded('y AS a7_resonance_ema', 'z AS a7_resonance_z', digits=4)} FROM e JOIN rz USING (symbol, date, seq)"
)
def p19_a7_smoothed(spark, d):
    """The resonance's exponential mean, and its distance from the mean of the last 200."""
    df = X.resonance_z(resonances(spark, d)).select("date", "ts", "seq", "a7_resonance", "a7_resonance_z")
    return shown(R.ema(df, "a7_resonance", "a7_resonance_ema", alpha=0.1, keys=("date",)), ("seq",), "a7_resonance_ema", "a7_resonance_z", digits=4)


_P23 = ("micro_deviation", "obi_1", "ofi_l1", "spread", "tick_through")
_P23_SQL = (
    V.with_views("clean")
    + f""", q AS (SELECT *, (bid + ask) / 2 AS mid, {_MICRO} AS micro_deviation, (bid_qty - ask_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) AS obi_1, ask - bid AS spread,
        {", ".join(f"{_lag(c)} AS p_{c}" for c in ("bid", "bid_qty", "ask", "ask_qty"))}, row_number() OVER {W} AS rn FROM clean),
    u AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE {_flow("bid", "bid_qty", True)} - {_flow("ask", "ask_qty", False)} END AS ofi_l1, lead(mid, 10) OVER {W} / mid - 1 AS fwd,
        mid - coalesce({_lag("mid")}, mid) AS mv FROM q),
    s AS (SELECT *, CASE WHEN abs(mv) >= 2 * 0.05::DOUBLE THEN sign(mv)::DOUBLE ELSE 0.0 END AS tick_through FROM u),
    x AS ({" UNION ALL ".join(f"SELECT symbol, date, '{g}' AS signal, {g}::DOUBLE AS x, fwd AS y FROM s WHERE fwd IS NOT NULL" for g in _P23)}),
    r AS (SELECT symbol, date, signal, rank() OVER (PARTITION BY symbol, date, signal ORDER BY x) + (count(*) OVER (PARTITION BY symbol, date, signal, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY symbol, date, signal ORDER BY y) + (count(*) OVER (PARTITION BY symbol, date, signal, y) - 1) / 2 AS ry FROM x),
    ic AS (SELECT signal, CASE WHEN count(*) >= 20 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM r GROUP BY symbol, date, signal),
    b AS (SELECT signal FROM ic WHERE ic IS NOT NULL GROUP BY signal ORDER BY abs(avg(ic) / (stddev_samp(ic) + 1e-9::DOUBLE)) DESC NULLS LAST, signal LIMIT 3),
    c AS (SELECT symbol, date, ts, seq, ({" + ".join(f"CASE WHEN '{g}' IN (SELECT signal FROM b) THEN {_z(g + '::DOUBLE', 100, 20)} ELSE 0 END" for g in _P23)}) / greatest((SELECT count(*) FROM b), 1) AS raw FROM s), """
    + ema_sql("c", "raw", 2 / 101)
)


@query(_P23_SQL + f" SELECT symbol, seq, {rounded('y AS data_driven_eq', digits=4)} FROM e")
def p23_data_driven_composite(spark, d):
    """The mean z of the three signals with the greatest information ratio at ten packets, smoothed.

    Which they are is a scalar subquery of the plan.
    """
    from tidebook.operators import evaluation as E

    q = X.tick_through(X.forward(X.flow_first(X.microprice(mids(spark, d))), (10,)))
    summary = E.ic_summary(E.signal_ic(q, _P23, (10,), least=20))
    best = summary.orderBy(F.desc_nulls_last(F.abs("icir")), "signal").limit(3).agg(F.collect_list("signal"))
    chosen = sum((F.array_contains("_top", c).cast("int") * (1 << i) for i, c in enumerate(_P23)), F.lit(0))
    df = q.withColumn("_top", best.scalar()).withColumn("_chosen", chosen).withColumns({c: F.col(c).cast("double") for c in _P23})
    return shown(R.mean_z_ema(df, _P23, "_chosen", "data_driven_eq", 100, 20, 100), KEYS, "data_driven_eq", digits=4)


def _p24_sql() -> str:
    """The features' own SQL, row by row beside each other."""
    parts = {
        "p5_a1_gradient": ("a1_asymmetry",),
        "p6_a2_fragmentation": ("a2_bid_fragmentation",),
        "p8_a3_symmetry": ("a3_symmetry_break",),
        "p9_a4_centre_of_gravity": ("a4_cog_divergence",),
        "p11_a5_activation": ("a5_condensation_signal",),
        "p12_a6_impact_depth": ("a6_ask_shallowing",),
        "p15_flow_levels": ("ofi_ml",),
        "p21_composite_raw": ("composite_raw",),
        "p20_composite": ("composite_eq",),
        "p22_flow_composite": ("flow_eq",),
    }
    sql = {name: ORACLE[name] for name in parts}
    sql["micro"] = V.with_views("book") + f" SELECT symbol, seq, {rounded(_MB + ' AS micro_deviation')} FROM book"
    sql["raw"] = _FLOW_RAW + f" SELECT symbol, seq, {rounded('raw AS flow_raw', digits=4)} FROM c"
    columns = [c for cs in parts.values() for c in cs] + ["micro_deviation", "flow_raw"]
    first, *rest = (f"({text}) t{i}" for i, text in enumerate(sql.values()))
    return f"SELECT symbol, seq, {', '.join(columns)} FROM {first}" + "".join(f" JOIN {t} USING (symbol, seq)" for t in rest)


@query(_p24_sql())
def p24_feature_pipeline(spark, d):
    """Every book feature in order, both composites smoothed in one grouped map."""
    df = X.centre_of_gravity(X.symmetry(X.fragmentation(X.gradient(_book_features(spark, d)))))
    df = X.flow_composite(X.composite(X.flow_levels(X.microprice(df))))
    plain = ["a1_asymmetry", "a2_bid_fragmentation", "a3_symmetry_break", "a4_cog_divergence", "micro_deviation", "ofi_ml"]
    whole, smooth = ["a5_condensation_signal", "a6_ask_shallowing"], ["composite_raw", "flow_raw"]
    df = R.emas(df.select("symbol", "date", "ts", "seq", *plain, *whole, *smooth), {"composite_raw": "composite_eq", "flow_raw": "flow_eq"}, span=100)
    df = shown(df, (*KEYS, *whole, *smooth, "composite_eq", "flow_eq"), *plain)
    return shown(df, (*KEYS, *whole, *plain), *smooth, "composite_eq", "flow_eq", digits=4)


_KF = """, o AS (SELECT symbol, date, seq, mid AS z, row_number() OVER (PARTITION BY symbol, date ORDER BY ts, seq) AS rn FROM (SELECT *, (bid + ask) / 2 AS mid FROM clean)),
    p AS (SELECT symbol, date, seq, rn, z AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM o WHERE rn = 1
      UNION ALL SELECT symbol, date, seq, rn, x1 + a1 / s * e, v + b1 / s * e, (1 - a1 / s) * a1, (1 - a1 / s) * b1, c1 - b1 / s * b1 FROM (
        SELECT o.symbol, o.date, o.seq, o.rn, p.x + p.v AS x1, p.v, p.a + 2 * p.b + p.c + 1e-6::DOUBLE / 3 AS a1, p.b + p.c + 1e-6::DOUBLE / 2 AS b1, p.c + 1e-6::DOUBLE AS c1,
          p.a + 2 * p.b + p.c + 1e-6::DOUBLE / 3 + 1e-2::DOUBLE AS s, o.z - (p.x + p.v) AS e FROM p JOIN o ON o.symbol = p.symbol AND o.date = p.date AND o.rn = p.rn + 1))"""


@query(V.with_views("clean") + _KF + f" SELECT symbol, seq, {rounded('x AS kf_level', 'v AS kf_velocity', digits=4)} FROM p")
def u11_kalman(spark, d):
    """By chunks of six hours of each session."""
    return shown(S.kalman_scan(mids(spark, d).select("symbol", "date", "ts", "seq", "mid"), CHUNK), KEYS, "kf_level", "kf_velocity", digits=4)


def _windows(spark, d):
    return G.blocks(V.ticks(spark, d).filter("mid > 0"), 60, 30)


BLOCK = ("symbol", "date", "block")
_BLOCKS = V.with_views("ticks") + f""", n AS (SELECT symbol, date, ts, seq, mid, row_number() OVER {W} - 1 AS rn FROM ticks WHERE mid > 0), nb AS (SELECT symbol, date, (rn // 60)::BIGINT AS block, (rn % 60)::INT AS i, ln(mid) AS x FROM n),
    w AS (SELECT * FROM nb QUALIFY count(*) OVER (PARTITION BY symbol, date, block) >= 30),
    r AS (SELECT *, x - lag(x) OVER b AS r FROM w WINDOW b AS (PARTITION BY symbol, date, block ORDER BY i)),
    q AS (SELECT *, CASE WHEN count(r) OVER f = 10 THEN sum(r) OVER f END AS q FROM r WINDOW f AS (PARTITION BY symbol, date, block ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    vr AS (SELECT symbol, date, block, count(r) AS n, CASE WHEN count(r) >= 11 AND var_pop(r) > 0 THEN var_pop(q) / (10 * var_pop(r)) END AS vr, sum(r) AS drift, stddev_pop(r) * sqrt(count(r)) AS vol FROM q GROUP BY ALL)"""


@query(_BLOCKS + f" SELECT symbol, date, block, n, {rounded('vr', digits=5)} FROM vr")
def u13_variance_ratio(spark, d):
    return shown(G.variance_ratio(_windows(spark, d), BLOCK, 10), (*BLOCK, "n"), "vr", digits=5)


_HURST = """, h0 AS (SELECT symbol, date, block, i, x, count(*) OVER (PARTITION BY symbol, date, block) AS n, unnest([8, 16, 32]) AS s FROM w),
    h1 AS (SELECT *, i // s AS seg FROM h0 WHERE s <= n // 2 AND i // s < n // s),
    h2 AS (SELECT *, x - avg(x) OVER (PARTITION BY symbol, date, block, s, seg) AS z FROM h1),
    h3 AS (SELECT *, sum(z) OVER (PARTITION BY symbol, date, block, s, seg ORDER BY i) AS c FROM h2),
    h4 AS (SELECT symbol, date, block, s, seg, (max(c) - min(c)) / stddev_pop(x) AS rs FROM h3 GROUP BY ALL HAVING stddev_pop(x) > 0),
    h5 AS (SELECT symbol, date, block, s, ln(avg(rs)) AS y FROM h4 GROUP BY ALL),
    hu AS (SELECT symbol, date, block, CASE WHEN count(*) >= 2 THEN regr_slope(y, ln(s)) END AS hurst FROM h5 GROUP BY ALL)"""


@query(_BLOCKS + _HURST + f" SELECT symbol, date, block, {rounded('hurst', digits=5)} FROM hu")
def u14_hurst(spark, d):
    return shown(G.hurst(_windows(spark, d), BLOCK), BLOCK, "hurst", digits=5)


_LABEL = """CASE WHEN n < 11 THEN 'unknown' WHEN abs(CASE WHEN vol > 0 THEN drift / vol ELSE 0 END) >= 1.5 THEN CASE WHEN drift > 0 THEN 'trend_up' ELSE 'trend_down' END WHEN vr <= 0.7 THEN 'mean_revert' ELSE 'chop' END"""


@query(_BLOCKS + f" SELECT symbol, date, block, n, {_LABEL} AS regime, {rounded('CASE WHEN vol > 0 THEN drift / vol ELSE 0 END AS drift_vol', digits=4)} FROM vr")
def u15_window_regime(spark, d):
    return shown(G.classify(_windows(spark, d), BLOCK), (*BLOCK, "n", "regime"), "drift_vol", digits=4)


@query(_BLOCKS + f", l AS (SELECT symbol, {_LABEL} AS regime FROM vr), c AS (SELECT symbol, regime, count(*) AS n_windows FROM l GROUP BY ALL) SELECT symbol, regime, n_windows, {rounded('n_windows / sum(n_windows) OVER (PARTITION BY symbol) AS share', digits=5)} FROM c")
def u16_regime_distribution(spark, d):
    c = G.classify(_windows(spark, d), BLOCK).groupBy("symbol", "regime").agg(F.count("*").alias("n_windows"))
    return shown(c.withColumn("share", F.col("n_windows") / F.sum("n_windows").over(Window.partitionBy("symbol"))), ("symbol", "regime", "n_windows"), "share", digits=5)


_BLOCK_KF = """, o AS (SELECT symbol, date, block, i, exp(x) AS z FROM w),
    p AS (SELECT symbol, date, block, i, z AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM o WHERE i = 0
      UNION ALL SELECT symbol, date, block, i, x1 + a1 / s * e, v + b1 / s * e, (1 - a1 / s) * a1, (1 - a1 / s) * b1, c1 - b1 / s * b1 FROM (
        SELECT o.symbol, o.date, o.block, o.i, p.x + p.v AS x1, p.v, p.a + 2 * p.b + p.c + 1e-6::DOUBLE / 3 AS a1, p.b + p.c + 1e-6::DOUBLE / 2 AS b1, p.c + 1e-6::DOUBLE AS c1,
          p.a + 2 * p.b + p.c + 1e-6::DOUBLE / 3 + 1e-2::DOUBLE AS s, o.z - (p.x + p.v) AS e FROM p JOIN o ON o.symbol = p.symbol AND o.date = p.date AND o.block = p.block AND o.i = p.i + 1)),
    kf AS (SELECT symbol, date, block, avg(v) AS velocity FROM p GROUP BY ALL), mo AS (SELECT symbol, date, block, arg_max(z, i) - arg_min(z, i) AS move, max(z) - min(z) AS span FROM o GROUP BY ALL)"""


@query(_BLOCKS + _BLOCK_KF + f" SELECT symbol, date, block, {_LABEL} AS regime, {rounded('velocity', 'move', 'span', digits=4)} FROM vr JOIN kf USING (symbol, date, block) JOIN mo USING (symbol, date, block)")
def u16_regime_run(spark, d):
    """Windows with their regime, mean filter velocity, move and range."""
    t = _windows(spark, d)
    k = R.kalman(t, "mid", keys=BLOCK).groupBy(*BLOCK).agg(F.avg("kf_velocity").alias("velocity"), (F.max_by("mid", "i") - F.min_by("mid", "i")).alias("move"), (F.max("mid") - F.min("mid")).alias("span"))
    return shown(G.classify(t, BLOCK).join(k, list(BLOCK)), (*BLOCK, "regime"), "velocity", "move", "span", digits=4)


# Pairs


def pairs(spark, d):
    b = V.bars(spark, d)
    x, y = b.select(F.col("symbol").alias("x"), "hour", F.ln("close").alias("la")), b.select(F.col("symbol").alias("y"), "hour", F.ln("close").alias("lb"))
    return x.join(y, "hour").filter("x < y")


_P = V.with_views("bars") + """, p AS (SELECT a.symbol AS x, b.symbol AS y, a.hour, ln(a.close) AS la, ln(b.close) AS lb FROM bars a JOIN bars b ON a.hour = b.hour AND a.symbol < b.symbol),
    f AS (SELECT x, y, count(*) AS n, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM p GROUP BY ALL),
    s AS (SELECT p.*, la - (alpha + beta * lb) AS s FROM p JOIN f USING (x, y))"""


@query(_P + f" SELECT x, y, n, {rounded('alpha', 'beta')} FROM f")
def u20_pair_fit(spark, d):
    return shown(G.pair_fit(pairs(spark, d)), ("x", "y", "n"), "alpha", "beta")


@query(
    _P
    + f""", l AS (SELECT x, y, hour, s, s - lag(s) OVER w AS dy, lag(s) OVER w AS l FROM s WINDOW w AS (PARTITION BY x, y ORDER BY hour)), a AS (SELECT *, lag(dy) OVER (PARTITION BY x, y ORDER BY hour) AS p FROM l),
    m AS (SELECT x, y, count(*) AS n, covar_pop(l, l) * count(*) AS ll, covar_pop(p, p) * count(*) AS pp, covar_pop(l, p) * count(*) AS lp, covar_pop(l, dy) * count(*) AS ly, covar_pop(p, dy) * count(*) AS py, covar_pop(dy, dy) * count(*) AS yy FROM a WHERE p IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, ll * pp - lp * lp AS det, (ly * pp - py * lp) / (ll * pp - lp * lp) AS b1, (py * ll - ly * lp) / (ll * pp - lp * lp) AS b2 FROM m)
    SELECT x, y, n, {rounded("b1 / sqrt((yy - b1 * ly - b2 * py) / (n - 3) * pp / det) AS adf_t", digits=5)} FROM b"""
)
def u17_engle_granger(spark, d):
    return shown(G.dickey_fuller(G.spread(pairs(spark, d)), ("x", "y"), "hour"), ("x", "y", "n"), "adf_t", digits=5)


@query(
    V.with_views("bars")
    + f""", p AS (SELECT a.symbol AS x, b.symbol AS y, a.hour, ln(a.close) AS la, ln(b.close) AS lb FROM bars a JOIN bars b ON a.hour = b.hour AND a.symbol < b.symbol),
    tm AS (SELECT hour, row_number() OVER (ORDER BY hour) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hour FROM p)), ct AS (SELECT max(hour) AS cut FROM tm WHERE i <= floor(n * 0.6::DOUBLE)),
    h AS (SELECT p.*, CASE WHEN hour <= cut THEN 'in' ELSE 'out' END AS half FROM p, ct),
    f AS (SELECT x, y, half, count(*) AS n, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM h GROUP BY ALL),
    hs AS (SELECT x, y, half, hour, la - (alpha + beta * lb) AS s FROM h JOIN f USING (x, y, half)),
    hl AS (SELECT *, s - lag(s) OVER w AS dy, lag(s) OVER w AS l FROM hs WINDOW w AS (PARTITION BY x, y, half ORDER BY hour)), hp AS (SELECT *, lag(dy) OVER (PARTITION BY x, y, half ORDER BY hour) AS p FROM hl),
    hm AS {"(SELECT x, y, half, count(*) AS n, " + ", ".join(f"covar_pop({a}, {b}) * count(*) AS {k}" for a, b, k in (("l", "l", "ll"), ("p", "p", "pp"), ("l", "p", "lp"), ("l", "dy", "ly"), ("p", "dy", "py"), ("dy", "dy", "yy"))) + " FROM hp WHERE p IS NOT NULL GROUP BY ALL)"},
    hb AS (SELECT *, ll * pp - lp * lp AS det, (ly * pp - py * lp) / (ll * pp - lp * lp) AS b1, (py * ll - ly * lp) / (ll * pp - lp * lp) AS b2 FROM hm),
    ht AS (SELECT x, y, half, b1 / sqrt((yy - b1 * ly - b2 * py) / (n - 3) * pp / det) AS t FROM hb),
    hz AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END::DOUBLE AS z FROM ht),
    hv AS (SELECT x, y, half, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 ELSE {N.cdf("z")} END AS p FROM hz),
    rb AS (SELECT x, y, CASE WHEN count(*) OVER k >= 120 THEN covar_samp(la, lb) OVER k / var_samp(lb) OVER k END AS b FROM p WINDOW k AS (PARTITION BY x, y ORDER BY hour ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
    rd AS (SELECT x, y, stddev_samp(b) AS beta_drift FROM rb GROUP BY ALL),
    mv AS (SELECT x, y, la - lag(la) OVER w AS a, lb - lag(lb) OVER w AS b FROM p WINDOW w AS (PARTITION BY x, y ORDER BY hour)), mc AS (SELECT x, y, count(*) AS n, corr(a, b) AS corr FROM mv GROUP BY ALL),
    wd AS (SELECT f.x, f.y, {", ".join(f"max(CASE WHEN f.half = '{h}' THEN {c} END) AS {n}_{h}" for h in ("in", "out") for c, n in (("f.n", "n"), ("f.beta", "beta"), ("hv.p", "p")))} FROM f LEFT JOIN hv USING (x, y, half) GROUP BY ALL)
    SELECT x, y, mc.n, p_in < 0.05 AND p_out < 0.05 AS kept, {rounded("beta_in", "beta_out", "p_in", "p_out", "beta_drift", "corr", digits=4)} FROM wd JOIN mc USING (x, y) JOIN rd USING (x, y) WHERE mc.n >= 500 AND n_in >= 300 AND n_out >= 200"""
)
def u18_pair_screen(spark, d):
    """Pairs whose residual is stationary in both parts of the sample (first 60 % of the bars, rest)."""
    return shown(G.pair_screen(pairs(spark, d)), ("x", "y", "n", "kept"), "beta_in", "beta_out", "p_in", "p_out", "beta_drift", "corr", digits=4)


@query(
    _P
    + f""", l AS (SELECT x, y, s, lag(s) OVER (PARTITION BY x, y ORDER BY hour) AS q FROM s), r AS (SELECT x, y, count(*) AS n, greatest(1e-6, least(0.999999, regr_slope(s, q))) AS b, regr_intercept(s, q) AS c, var_pop(s) AS vy, var_pop(q) AS vx, covar_pop(q, s) AS cxy FROM l WHERE q IS NOT NULL GROUP BY ALL)
    SELECT x, y, n, {rounded("b", "-ln(b) AS theta", "ln(2) / -ln(b) AS half_life", "c / (1 - b) AS mu", "sqrt((vy - 2 * b * cxy + b * b * vx) / (1 - b * b)) AS sigma_eq", digits=5)} FROM r"""
)
def u19_ou_fit(spark, d):
    return shown(G.ou_fit(G.spread(pairs(spark, d)), ("x", "y"), "hour"), ("x", "y", "n"), "b", "theta", "half_life", "mu", "sigma_eq", digits=5)


def _positions(spark, d):
    s = G.spread(pairs(spark, d)).withColumns({"ts": F.col("hour"), "seq": F.lit(0).cast("long")})
    f = C.rolling(Window.partitionBy("x", "y").orderBy("hour"), 24)
    z = F.when(F.count("s").over(f) >= 24, F.try_divide(F.col("s") - F.avg("s").over(f), F.stddev_samp("s").over(f)))
    return R.fade_positions(s.withColumn("z", z).select("x", "y", "hour", "ts", "seq", "s", "z"))


_LEGS = "lc AS (SELECT symbol, median((ask - bid) / ((bid + ask) / 2)) * 1e4 + 0.000125::DOUBLE * 1e4 + 40 / (median((bid + ask) / 2) * 550) * 1e4 AS bps FROM clean GROUP BY symbol)"
_FADE = (
    _P.replace(V.with_views("bars"), V.with_views("bars", "clean"), 1)
    + f""", {_LEGS}, co AS (SELECT a.symbol AS x, b.symbol AS y, (a.bps + b.bps) / 1e4 / 2 AS turn FROM lc a JOIN lc b ON a.symbol < b.symbol),
    z AS (SELECT x, y, hour, s, row_number() OVER (PARTITION BY x, y ORDER BY hour) AS rn, CASE WHEN count(s) OVER f >= 24 THEN (s - avg(s) OVER f) / stddev_samp(s) OVER f END AS z FROM s WINDOW f AS (PARTITION BY x, y ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    t AS (SELECT x, y, hour, s, rn, 0.0::DOUBLE AS state, 0.0::DOUBLE AS pos FROM z WHERE rn = 1 UNION ALL
      SELECT z.x, z.y, z.hour, z.s, z.rn, CASE WHEN z.z IS NULL THEN t.state WHEN t.state = 0 THEN CASE WHEN abs(z.z) > 2 THEN -sign(z.z)::DOUBLE ELSE 0 END WHEN abs(z.z) < 0.5 OR abs(z.z) > 4 THEN 0 ELSE t.state END,
        CASE WHEN z.z IS NULL THEN 0 WHEN t.state = 0 THEN CASE WHEN abs(z.z) > 2 THEN -sign(z.z)::DOUBLE ELSE 0 END WHEN abs(z.z) < 0.5 OR abs(z.z) > 4 THEN 0 ELSE t.state END
      FROM t JOIN z ON z.x = t.x AND z.y = t.y AND z.rn = t.rn + 1),
    nt AS (SELECT x, y, hour, coalesce(lag(pos) OVER w, 0) * coalesce(s - lag(s) OVER w, 0) - coalesce(abs(pos - lag(pos) OVER w), 0) * turn AS net FROM t JOIN co USING (x, y) WINDOW w AS (PARTITION BY x, y ORDER BY hour)),
    fd AS (SELECT x, y, CAST(hour AS DATE) AS day, sum(net) AS net FROM nt GROUP BY ALL)"""
)


def _fade_days(spark, d):
    """x, y, day, net: position before times the spread's change, less half the legs' costs for each turn."""
    w = Window.partitionBy("x", "y").orderBy("hour")
    back = lambda c: F.lag(c).over(w)
    q = mids(spark, d)
    leg = leg_costs(q)
    p = _positions(spark, d).join(leg.select(F.col("symbol").alias("x"), F.col("bps").alias("bx")), "x").join(leg.select(F.col("symbol").alias("y"), F.col("bps").alias("by")), "y")
    turn = (F.col("bx") + F.col("by")) / 1e4 / 2
    net = F.coalesce(back("pos"), F.lit(0.0)) * F.coalesce(F.col("s") - back("s"), F.lit(0.0)) - F.coalesce(F.abs(F.col("pos") - back("pos")), F.lit(0.0)) * turn
    return p.withColumn("net", net).groupBy("x", "y", F.to_date("hour").alias("day")).agg(F.sum("net").alias("net"))


@query(_FADE + f" SELECT x, y, day, {rounded('net', digits=5)} FROM fd")
def e13_pair_strategy(spark, d):
    """Daily result of fading the spread."""
    return shown(_fade_days(spark, d), ("x", "y", "day"), "net", digits=5)


@query(
    _FADE
    + ", pd AS (SELECT x || '/' || y AS pair, day, net AS pnl FROM fd), gp AS (SELECT pair FROM pd GROUP BY pair HAVING count(*) >= 3 AND stddev_samp(pnl) > 0), gd AS (SELECT * FROM pd WHERE pair IN (SELECT pair FROM gp))"
    + deflated_sql("gd", "pair", "pnl", True, True)
    + N.overfit("gd", "pair", "day", "pnl")
    + f" SELECT arm AS pair, n AS days, {rounded('sharpe', 'psr', 'dsr', '(SELECT pbo FROM pb) AS pbo', digits=4)} FROM df"
)
def u21_pair_gauntlet(spark, d):
    """Sharpe, PSR, deflated Sharpe of each pair's daily results, and the pairs' probability of overfitting.

    Pairs with fewer than three days or without variance are left out.
    """
    from tidebook.operators import evaluation as E

    daily = _fade_days(spark, d).select(F.concat_ws("/", "x", "y").alias("pair"), "day", F.col("net").alias("pnl"))
    good = daily.groupBy("pair").agg(F.count("*").alias("_n"), F.stddev_samp("pnl").alias("_sd")).filter("_n >= 3 AND _sd > 0").select("pair")
    daily = daily.join(good, "pair", "left_semi")
    out = E.deflated(daily, "pair", every_day=True, normal=True).crossJoin(F.broadcast(E.pbo(daily, "pair").select("pbo")))
    return shown(out.withColumnRenamed("n", "days"), ("pair", "days"), "sharpe", "psr", "dsr", "pbo", digits=4)
