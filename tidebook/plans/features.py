"""Row-wise and rolling order-book features over the quote and book views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import evaluation as E
from tidebook.operators import features as X
from tidebook.sources import views as V

from .registry import query, rounded, shown

KEYS = ("symbol", "seq")
W = "(PARTITION BY symbol, date ORDER BY ts, seq)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol, date ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER {W}"


def _z(c: str, n: int, least: int) -> str:
    f = frame(n)
    sd = f"stddev_samp({c}) OVER {f}"
    return f"CASE WHEN count({c}) OVER {f} >= {least} THEN ({c} - avg({c}) OVER {f}) / (CASE WHEN {sd} < 1e-12 THEN 0 ELSE {sd} END + 1e-9::DOUBLE) END"


def _over(n: int, body: str, first: int = 1) -> str:
    return f"list_sum(list_transform(range({first}, {first + n}), lambda i: {body}))"


def _quotes(spark, d):
    return V.clean(V.quotes(spark, d))


def _book(spark, d):
    return X.mid_of_book(V.book(spark, d))


@query(
    V.with_views("clean")
    + f""" SELECT symbol, seq, {rounded("(bid + ask) / 2 AS mid", "ask - bid AS spread", "(bid_qty - ask_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) AS obi_1")},
    round_even((ask - bid) / 0.05::DOUBLE, 0)::BIGINT AS spread_ticks FROM clean"""
)
def p1_quote_columns(spark, d):
    df = X.quote_columns(_quotes(spark, d))
    return shown(df, (*KEYS, "spread_ticks"), "mid", "spread", "obi_1")


@query(
    V.with_views("book")
    + f""" SELECT symbol, seq, {rounded("(list_sum(bid_qty) - list_sum(ask_qty)) / (list_sum(bid_qty) + list_sum(ask_qty) + 1e-9::DOUBLE) AS obi", "(bid_qty[1] - ask_qty[1]) / (bid_qty[1] + ask_qty[1] + 1e-9::DOUBLE) AS obi_1")} FROM book"""
)
def p2_depth_imbalance(spark, d):
    b, a = F.col("bid_qty")[0].cast("double"), F.col("ask_qty")[0].cast("double")
    return shown(X.depth_imbalance(V.book(spark, d)).withColumn("obi_1", (b - a) / (b + a + C.EPS)), KEYS, "obi", "obi_1")


@query(
    V.with_views("ticks")
    + """ SELECT symbol, seq FROM ticks WHERE extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) + (extract(microsecond FROM ts) % 1000000) / 1e6 BETWEEN 33600 AND 55500"""
)
def p3_session_filter(spark, d):
    """09:20 to 15:25, both ends included."""
    return V.ticks(spark, d).filter((F.col("ts") >= F.col("date") + F.expr("INTERVAL '09:20' HOUR TO MINUTE")) & (F.col("ts") <= F.col("date") + F.expr("INTERVAL '15:25' HOUR TO MINUTE"))).select(*KEYS)


@query(V.with_views("clean") + " SELECT symbol, seq FROM clean")
def p4_garbage_filter(spark, d):
    return _quotes(spark, d).select(*KEYS)


_SLOPE = {s: _over(20, f"({s}_qty[i] / greatest({s}_orders[i], 1)) * (i - 10.5::DOUBLE) / 665.0::DOUBLE") for s in ("bid", "ask")}


@query(
    V.with_views("book")
    + f""", s AS (SELECT *, {_SLOPE["bid"]} AS bs, {_SLOPE["ask"]} AS sl FROM book),
    v AS (SELECT *, bs - {_lag("bs", 10)} AS bv, sl - {_lag("sl", 10)} AS av FROM s)
    SELECT symbol, seq, {rounded("bs AS a1_bid_slope", "sl AS a1_ask_slope", "bv AS a1_bid_velocity", "av AS a1_ask_velocity", "bv - av AS a1_asymmetry")} FROM v"""
)
def p5_a1_gradient(spark, d):
    return shown(X.gradient(V.book(spark, d)), KEYS, "a1_bid_slope", "a1_ask_slope", "a1_bid_velocity", "a1_ask_velocity", "a1_asymmetry")


@query(
    V.with_views("book")
    + f""", m AS (SELECT *, {_over(5, "(bid_qty[i] / greatest(bid_orders[i], 1))")} / 5 AS mb, {_over(5, "(ask_qty[i] / greatest(ask_orders[i], 1))")} / 5 AS ma FROM book)
    SELECT symbol, seq, {rounded(
        "sqrt(" + _over(5, "power(bid_qty[i] / greatest(bid_orders[i], 1) - mb, 2)") + " / 5) / (mb + 1e-9::DOUBLE) AS a2_bid_fragmentation",
        "sqrt(" + _over(5, "power(ask_qty[i] / greatest(ask_orders[i], 1) - ma, 2)") + " / 5) / (ma + 1e-9::DOUBLE) AS a2_ask_fragmentation",
    )} FROM m"""
)
def p6_a2_fragmentation(spark, d):
    return shown(X.fragmentation(V.book(spark, d)), KEYS, "a2_bid_fragmentation", "a2_ask_fragmentation")


def _sums(tag: str, first: int, n: int) -> str:
    return ", ".join(f"{_over(n, f'{s}_qty[i] + 1e-9::DOUBLE', first)} AS s{s[0]}{tag}" for s in ("bid", "ask"))


def _div(p: str, tag: str, first: int, n: int) -> str:
    q = "ask" if p == "bid" else "bid"
    x, y = f"(({p}_qty[i] + 1e-9::DOUBLE) / s{p[0]}{tag})", f"(({q}_qty[i] + 1e-9::DOUBLE) / s{q[0]}{tag})"
    return _over(n, f"{x} * ln({x} / {y})", first)


#: Sums of the sides and the symmetry break over them, for other queries.
_SUMS_W = (_sums("w", 1, 20), _div("bid", "w", 1, 20) + " - " + _div("ask", "w", 1, 20))


@query(
    V.with_views("book")
    + f""", s AS (SELECT *, {_sums("w", 1, 20)}, {_sums("t", 1, 5)}, {_sums("d", 6, 15)} FROM book)
    SELECT symbol, seq, {rounded(
        _div("bid", "w", 1, 20) + " AS a3_kl_bid_from_ask",
        _div("ask", "w", 1, 20) + " AS a3_kl_ask_from_bid",
        _div("bid", "w", 1, 20) + " - " + _div("ask", "w", 1, 20) + " AS a3_symmetry_break",
        _div("bid", "t", 1, 5) + " - " + _div("ask", "t", 1, 5) + " AS a3_symmetry_break_top",
        _div("bid", "d", 6, 15) + " - " + _div("ask", "d", 6, 15) + " AS a3_symmetry_break_deep",
    )} FROM s"""
)
def p8_a3_symmetry(spark, d):
    return shown(X.symmetry(V.book(spark, d)), KEYS, "a3_kl_bid_from_ask", "a3_kl_ask_from_bid", "a3_symmetry_break", "a3_symmetry_break_top", "a3_symmetry_break_deep")


@query(
    V.with_views("book")
    + f""", c AS (SELECT *, {_over(20, "bid_price[i] * bid_qty[i]")} / (list_sum(bid_qty) + 1e-9::DOUBLE) AS b, {_over(20, "ask_price[i] * ask_qty[i]")} / (list_sum(ask_qty) + 1e-9::DOUBLE) AS a FROM book),
    v AS (SELECT *, b - {_lag("b", 10)} AS vb, a - {_lag("a", 10)} AS va FROM c)
    SELECT symbol, seq, coalesce(sign(vb) = sign(va), false) AS a4_cog_aligned, {rounded("a - b AS a4_cog_spread", "(b + a) / 2 - (bid_price[1] + ask_price[1]) / 2 AS a4_cog_midpoint", "vb AS a4_bid_cog_vel", "va AS a4_ask_cog_vel", "vb - va AS a4_cog_divergence")} FROM v"""
)
def p9_a4_centre_of_gravity(spark, d):
    return shown(X.centre_of_gravity(_book(spark, d)), (*KEYS, "a4_cog_aligned"), "a4_cog_spread", "a4_cog_midpoint", "a4_bid_cog_vel", "a4_ask_cog_vel", "a4_cog_divergence")


@query(V.with_views("book") + " SELECT symbol, date, coalesce(min(CASE WHEN bid_qty[1] > 0 THEN bid_qty[1] END), 550) AS lot FROM book GROUP BY ALL")
def p10_lot_size(spark, d):
    return X.lot_size(V.book(spark, d)).groupBy("symbol", "date").agg(F.max("lot").alias("lot"))


_COUNT = {s: f"len(list_filter({s}_qty, lambda q: q > 120))::DOUBLE" for s in ("bid", "ask")}
_A5 = f"""a5 AS (SELECT *, cb - {_lag("cb", 20)} AS vb5, ca - {_lag("ca", 20)} AS va5 FROM (SELECT *, {_COUNT["bid"]} AS cb, {_COUNT["ask"]} AS ca FROM book))"""
_DEPTH = {s: f"least(1 + len(list_filter(range(1, 21), lambda i: list_sum({s}_qty[1:i]) < 800)), 20)::DOUBLE" for s in ("bid", "ask")}
_A6 = f"""a6 AS (SELECT *, db - {_lag("db", 20)} AS vb6, da - {_lag("da", 20)} AS va6 FROM (SELECT *, {_DEPTH["bid"]} AS db, {_DEPTH["ask"]} AS da FROM a5))"""


@query(V.with_views("book") + f", {_A5} SELECT symbol, seq, cb AS a5_bid_active_count, ca AS a5_ask_active_count, vb5 AS a5_bid_condensation, va5 AS a5_ask_condensation, vb5 - va5 AS a5_condensation_signal FROM a5")
def p11_a5_activation(spark, d):
    df = X.activation(V.book(spark, d), F.lit(120))
    return df.select(*KEYS, "a5_bid_active_count", "a5_ask_active_count", "a5_bid_condensation", "a5_ask_condensation", "a5_condensation_signal")


@query(V.with_views("book") + f", {_A5}, {_A6} SELECT symbol, seq, db AS a6_bid_impact_depth, da AS a6_ask_impact_depth, vb6 AS a6_bid_shallowing, va6 AS a6_ask_shallowing, coalesce(vb6 < -2 OR va6 < -2, false) AS a6_thin_book FROM a6")
def p12_a6_impact_depth(spark, d):
    df = X.impact_depth(V.book(spark, d), F.lit(800))
    return df.select(*KEYS, "a6_bid_impact_depth", "a6_ask_impact_depth", "a6_bid_shallowing", "a6_ask_shallowing", "a6_thin_book")


_MICRO = "(bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) - (bid + ask) / 2"


@query(V.with_views("clean") + f" SELECT symbol, seq, {rounded(_MICRO + ' AS micro_deviation')} FROM clean")
def p13_microprice(spark, d):
    return shown(X.microprice(_quotes(spark, d)), KEYS, "micro_deviation")


@query(V.with_views("clean") + f" SELECT symbol, seq, {rounded('(bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) - (bid + ask) / 2 AS micro_signal')} FROM clean")
def p14_micro_signal(spark, d):
    return shown(X.micro_signal(_quotes(spark, d)), KEYS, "micro_signal")


def _flow(p: str, q: str, up: bool) -> str:
    a, b = (">", "<") if up else ("<", ">")
    return f"(CASE WHEN {p} {a} p_{p} THEN {q} WHEN {p} {b} p_{p} THEN -p_{q} ELSE {q} - p_{q} END)"


_BEFORE = ", ".join(f"{_lag(c)} AS p_{c}" for c in ("bid_price", "bid_qty", "ask_price", "ask_qty"))
_OFI = " + ".join(
    f"{0.5**k}::DOUBLE * (" + _flow("bid_price", "bid_qty", True).replace("bid_price", f"bid_price[{k + 1}]").replace("bid_qty", f"bid_qty[{k + 1}]") + " - " + _flow("ask_price", "ask_qty", False).replace("ask_price", f"ask_price[{k + 1}]").replace("ask_qty", f"ask_qty[{k + 1}]") + ")"
    for k in range(10)
)


@query(V.with_views("book") + f", l AS (SELECT *, {_BEFORE}, row_number() OVER {W} AS rn FROM book) SELECT symbol, seq, {rounded(f'CASE WHEN rn = 1 THEN 0 ELSE {_OFI} END AS ofi_ml')} FROM l")
def p15_flow_levels(spark, d):
    return shown(X.flow_levels(V.book(spark, d)), KEYS, "ofi_ml")


@query(
    V.with_views("clean")
    + f""", l AS (SELECT *, {", ".join(f"{_lag(c)} AS p_{c}" for c in ("bid", "bid_qty", "ask", "ask_qty"))}, row_number() OVER {W} AS rn FROM clean)
    SELECT symbol, seq, CASE WHEN rn = 1 THEN 0 ELSE {_flow("bid", "bid_qty", True)} - {_flow("ask", "ask_qty", False)} END AS ofi_l1 FROM l"""
)
def p16_flow_first(spark, d):
    return X.flow_first(_quotes(spark, d)).select(*KEYS, "ofi_l1")


_MOVE = f"mid - coalesce({_lag('mid')}, mid)"
_TT = f"tt AS (SELECT *, CASE WHEN abs(mv) >= 2 * 0.05::DOUBLE THEN sign(mv)::DOUBLE ELSE 0.0 END AS t FROM (SELECT *, {_MOVE} AS mv FROM ticks))"


@query(V.with_views("ticks") + f", {_TT} SELECT symbol, seq, t AS tick_through, CASE WHEN count(t) OVER {frame(50)} >= 50 THEN sum(t) OVER {frame(50)} END AS tick_through_sum FROM tt")
def p17_tick_through(spark, d):
    return X.tick_through(V.ticks(spark, d)).select(*KEYS, "tick_through", "tick_through_sum")


def _stab(s: str) -> str:
    f = frame(20)
    return f"CASE WHEN count(mid) OVER {f} >= 20 THEN ((max(mid) OVER {f} - min(mid) OVER {f}) / 0.05::DOUBLE) / (stddev_samp({s}_qty) OVER {f} / (avg({s}_qty) OVER {f} + 1e-9::DOUBLE) + 1e-3::DOUBLE) END"


@query(
    V.with_views("clean")
    + f""", m AS (SELECT *, (bid + ask) / 2 AS mid FROM clean), s AS (SELECT symbol, seq, {_stab("bid")} AS b, {_stab("ask")} AS a FROM m)
    SELECT symbol, seq, {rounded("b AS l1_stab_bid", "a AS l1_stab_ask", "b - a AS l1_stab_signal", digits=4)} FROM s"""
)
def p18_stability(spark, d):
    return shown(X.stability(X.quote_columns(_quotes(spark, d))), KEYS, "l1_stab_bid", "l1_stab_ask", "l1_stab_signal", digits=4)


_RAW = f"{_z('va6', 100, 20)} - {_z('vb6', 100, 20)} + {_z('sig', 100, 20)}"


@query(V.with_views("book") + f", {_A5}, {_A6}, r AS (SELECT *, vb5 - va5 AS sig FROM a6) SELECT symbol, seq, {rounded(f'{_RAW} AS composite_raw', digits=4)} FROM r")
def p21_composite_raw(spark, d):
    df = X.impact_depth(X.activation(V.book(spark, d), F.lit(120)), F.lit(800))
    return shown(X.composite(df), KEYS, "composite_raw", digits=4)


@query(
    V.with_views("clean")
    + f""", l AS (SELECT *, ln(greatest(ask - bid, 1e-6::DOUBLE)) AS lg FROM clean) SELECT symbol, seq, {rounded(_z("lg", 500, 10) + " AS log_spread_z", digits=4)} FROM l"""
)
def p25_log_spread_z(spark, d):
    df = _quotes(spark, d).withColumn("lg", F.ln(F.greatest(F.col("ask") - F.col("bid"), F.lit(1e-6))))
    return shown(df.withColumn("log_spread_z", C.zscore(F.col("lg"), C.session(), 500, 10)), KEYS, "log_spread_z", digits=4)


@query(
    V.with_views("clean")
    + f""", m AS (SELECT *, {_MICRO} AS md, (bid_qty - ask_qty) / (bid_qty + ask_qty + 1e-9::DOUBLE) AS obi FROM clean) SELECT symbol, seq FROM m WHERE sign(md) = sign(obi)"""
)
def p26_agreement_gate(spark, d):
    df = X.quote_columns(X.microprice(_quotes(spark, d)))
    return df.filter(F.signum("micro_deviation") == F.signum("obi_1")).select(*KEYS)


@query(V.with_views("clean") + f", m AS (SELECT *, (bid + ask) / 2 AS mid FROM clean) SELECT symbol, seq, {rounded(*[f'lead(mid, {h}) OVER {W} / mid - 1 AS fwd_{h}' for h in (1, 5, 10, 20)])} FROM m")
def p27_forward_ratio(spark, d):
    return shown(X.forward(X.quote_columns(_quotes(spark, d)), (1, 5, 10, 20)), KEYS, "fwd_1", "fwd_5", "fwd_10", "fwd_20")


@query(V.with_views("clean") + f", m AS (SELECT *, (bid + ask) / 2 AS mid FROM clean) SELECT symbol, seq, {rounded(*[f'lead(mid, {h}) OVER {W} - mid AS fwd_{h}' for h in (1, 5, 10)])} FROM m")
def p27_forward_difference(spark, d):
    return shown(X.forward(X.quote_columns(_quotes(spark, d)), (1, 5, 10), ratio=False), KEYS, "fwd_1", "fwd_5", "fwd_10")


_FEE = """(40 + 0.00002::DOUBLE * (buy + sell) + 0.000001::DOUBLE * (buy + sell) + 0.000125::DOUBLE * sell + 0.00002::DOUBLE * buy
    + 0.18::DOUBLE * (40 + 0.00002::DOUBLE * (buy + sell) + 0.000001::DOUBLE * (buy + sell)))"""


@query(
    V.with_views("trades")
    + f""", s AS (SELECT *, CASE WHEN direction > 0 THEN price ELSE price * 1.01::DOUBLE END * qty AS buy, CASE WHEN direction > 0 THEN price * 1.01::DOUBLE ELSE price END * qty AS sell FROM trades)
    SELECT order_key, line, part_key, supp_key, {rounded(_FEE + " AS charges", digits=2)} FROM s"""
)
def p28_fee_model(spark, d):
    t = V.trades(spark, d)
    return shown(t.withColumn("charges", C.round_trip_fee(F.col("price"), F.col("price") * 1.01, F.col("qty"), F.col("direction"))), ("order_key", "line", "part_key", "supp_key"), "charges", digits=2)


@query(V.with_views("trades") + f" SELECT order_key, line, part_key, supp_key, {rounded('price + direction * 0.05::DOUBLE AS entry_price', 'price - direction * 0.05::DOUBLE AS exit_price', digits=8)} FROM trades")
def p29_slippage(spark, d):
    df = V.trades(spark, d).withColumns({"entry_price": C.slipped(F.col("price"), F.col("direction"), True), "exit_price": C.slipped(F.col("price"), F.col("direction"), False)})
    return shown(df, ("order_key", "line", "part_key", "supp_key"), "entry_price", "exit_price", digits=8)


@query(
    V.with_views("clean")
    + f""", m AS (SELECT *, (bid + ask) / 2 * 550 AS buy, (bid + ask) / 2 * 550 AS sell FROM clean)
    SELECT symbol, seq, (ask - bid) / 2 >= {_FEE} / 550 AS edge_ok, {rounded(f"(ask - bid) / 2 / ({_FEE} / 550) AS edge_ratio", digits=4)} FROM m"""
)
def p30_edge_gate(spark, d):
    """Whether half the spread pays the charges of a round trip at the mid."""
    q = X.quote_columns(_quotes(spark, d))
    even = C.round_trip_fee(F.col("mid"), F.col("mid"), F.lit(550), F.lit(1)) / 550
    half = F.col("spread") / 2
    return shown(q.withColumns({"edge_ok": half >= even, "edge_ratio": half / even}), (*KEYS, "edge_ok"), "edge_ratio", digits=4)


def leg_costs(q):
    """symbol, bps: cost of one leg of a pair by its median spread and mid (q: symbol, spread, mid)."""
    spread = E.percentiles(q.select("symbol", (F.col("spread") / F.col("mid")).alias("share")), ("symbol",), "share", {"spread": 0.5})
    mid = E.percentiles(q, ("symbol",), "mid", {"mid": 0.5})
    return spread.join(mid, "symbol").select("symbol", (F.col("spread") * 1e4 + 1.25 + 40 / (F.col("mid") * 550) * 1e4).alias("bps"))


@query(
    V.with_views("clean")
    + f" SELECT symbol, {rounded('median((ask - bid) / ((bid + ask) / 2)) * 1e4 + 0.000125::DOUBLE * 1e4 + 40 / (median((bid + ask) / 2) * 550) * 1e4 AS leg_cost_bps', digits=4)} FROM clean GROUP BY symbol"
)
def p31_leg_cost(spark, d):
    """Cost of one leg of a pair in basis points: spread, transaction tax, brokerage."""
    q = X.quote_columns(_quotes(spark, d))
    return shown(leg_costs(q).withColumnRenamed("bps", "leg_cost_bps"), ("symbol",), "leg_cost_bps", digits=4)


_RESONANCE = f"""a AS (SELECT * FROM book WHERE symbol = 'S0'), b AS (SELECT ts AS ts_b, bid_qty AS bq, ask_qty AS aq FROM book WHERE symbol = 'S1'),
    p AS (SELECT a.*, b.bq, b.aq FROM a ASOF LEFT JOIN b ON a.ts >= b.ts_b),
    r AS (SELECT date, ts, seq, {", ".join(_over(20, f"{x}_qty[i] * {x[0]}q[i]") + f" / (sqrt({_over(20, f'{x}_qty[i] * {x}_qty[i]')}) * sqrt({_over(20, f'{x[0]}q[i] * {x[0]}q[i]')}) + 1e-9::DOUBLE) AS r{x[0]}" for x in ("bid", "ask"))} FROM p)"""


def resonances(spark, d):
    from tidebook.operators.joins import asof

    book = V.book(spark, d)
    left = book.filter("symbol = 'S0'").select("date", "ts", "seq", *[F.col(f"{s}_qty").alias(f"{s}_qty_a") for s in ("bid", "ask")])
    right = book.filter("symbol = 'S1'").select("date", "ts", "seq", *[F.col(f"{s}_qty").alias(f"{s}_qty_b") for s in ("bid", "ask")])
    return X.resonance(asof(left, right, keys=("date",)))


@query(V.with_views("book") + f", {_RESONANCE} SELECT seq, {rounded('rb AS a7_bid_resonance', 'ra AS a7_ask_resonance', '(rb + ra) / 2 AS a7_resonance')} FROM r")
def p19_a7_resonance(spark, d):
    return shown(resonances(spark, d), ("seq",), "a7_bid_resonance", "a7_ask_resonance", "a7_resonance")
