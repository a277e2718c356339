"""Order-book features. Frames carry the keys and the order (ts, seq); each function adds columns.

Levels are arrays. Differences and rolling values are windows over a session's rows, so all of
a pipeline's features share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.columns import EPS, SESSION, cosine, dot, flow, gated, kl, micro_deviation, rolling, session, total, zscore

TICK = 0.05
LEVELS = 20


def _double(name: str) -> Column:
    return F.transform(name, lambda x: x.cast("double"))


def _since(c: Column, n: int, w) -> Column:
    return c - F.lag(c, n).over(w)


def quote_columns(df: DataFrame, tick: float = TICK) -> DataFrame:
    """mid, spread, spread in ticks (half to even) and imbalance of the first level."""
    spread = F.col("ask") - F.col("bid")
    b, a = F.col("bid_qty").cast("double"), F.col("ask_qty").cast("double")
    return df.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": spread, "spread_ticks": F.bround(spread / tick).cast("long"), "obi_1": (b - a) / (b + a + EPS)})


def depth_imbalance(df: DataFrame) -> DataFrame:
    b, a = total(_double("bid_qty")), total(_double("ask_qty"))
    return df.withColumn("obi", (b - a) / (b + a + EPS))


def mid_of_book(df: DataFrame) -> DataFrame:
    return df.withColumn("mid", (F.col("bid_price")[0] + F.col("ask_price")[0]) / 2)


def _mean_order(side: str) -> Column:
    return F.zip_with(f"{side}_qty", f"{side}_orders", lambda q, n: q / F.greatest(n, F.lit(1)))


def gradient(df: DataFrame, lag: int = 10, keys=SESSION) -> DataFrame:
    """a1: slope of the mean order size over levels, its change and the sides' difference."""
    w = session(*keys)
    slope = lambda side: total(F.transform(_mean_order(side), lambda x, i: x * (i - 9.5) / 665.0))
    df = df.withColumns({f"a1_{s}_slope": slope(s) for s in ("bid", "ask")})
    df = df.withColumns({f"a1_{s}_velocity": _since(F.col(f"a1_{s}_slope"), lag, w) for s in ("bid", "ask")})
    return df.withColumn("a1_asymmetry", F.col("a1_bid_velocity") - F.col("a1_ask_velocity"))


def fragmentation(df: DataFrame, top: int = 5) -> DataFrame:
    """a2: population deviation over mean of the mean order size of the first levels."""

    def ratio(side: str) -> Column:
        x = F.slice(_mean_order(side), 1, top)
        mean = total(x) / top
        return F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / top) / (mean + EPS)

    return df.withColumns({f"a2_{s}_fragmentation": ratio(s) for s in ("bid", "ask")})


def symmetry(df: DataFrame) -> DataFrame:
    """a3: divergence of the sides' size distributions, whole, first five levels, the rest."""
    b, a = _double("bid_qty"), _double("ask_qty")
    part = lambda x, i, n: F.slice(x, i, n)
    gap = lambda i, n: kl(part(b, i, n), part(a, i, n)) - kl(part(a, i, n), part(b, i, n))
    return df.withColumns(
        {"a3_kl_bid_from_ask": kl(b, a), "a3_kl_ask_from_bid": kl(a, b), "a3_symmetry_break": gap(1, LEVELS), "a3_symmetry_break_top": gap(1, 5), "a3_symmetry_break_deep": gap(6, LEVELS - 5)}
    )


def centre_of_gravity(df: DataFrame, lag: int = 10, keys=SESSION) -> DataFrame:
    """a4: size-weighted price of each side, and how they move. Needs mid."""
    w = session(*keys)
    cog = lambda s: dot(F.col(f"{s}_price"), _double(f"{s}_qty")) / (total(_double(f"{s}_qty")) + EPS)
    df = df.withColumns({"a4_bid_cog": cog("bid"), "a4_ask_cog": cog("ask")})
    b, a = F.col("a4_bid_cog"), F.col("a4_ask_cog")
    df = df.withColumns({"a4_cog_spread": a - b, "a4_cog_midpoint": (b + a) / 2 - F.col("mid"), "a4_bid_cog_vel": _since(b, lag, w), "a4_ask_cog_vel": _since(a, lag, w)})
    vb, va = F.col("a4_bid_cog_vel"), F.col("a4_ask_cog_vel")
    return df.withColumns({"a4_cog_aligned": F.coalesce(F.signum(vb) == F.signum(va), F.lit(False)), "a4_cog_divergence": vb - va})


def lot_size(df: DataFrame, default: int = 550, keys=SESSION) -> DataFrame:
    """The least positive first-level bid size of the session."""
    q = F.col("bid_qty")[0]
    return df.withColumn("lot", F.coalesce(F.min(F.when(q > 0, q)).over(Window.partitionBy(*keys)), F.lit(default)))


def activation(df: DataFrame, threshold: Column, lag: int = 20, keys=SESSION) -> DataFrame:
    """a5: levels larger than the threshold, and how their number changes."""
    w = session(*keys)
    df = df.withColumn("_threshold", threshold)
    count = lambda s: F.aggregate(f"{s}_qty", F.lit(0.0), lambda n, q: n + F.when(q > F.col("_threshold"), 1.0).otherwise(0.0))
    df = df.withColumns({f"a5_{s}_active_count": count(s) for s in ("bid", "ask")}).drop("_threshold")
    df = df.withColumns({f"a5_{s}_condensation": _since(F.col(f"a5_{s}_active_count"), lag, w) for s in ("bid", "ask")})
    return df.withColumn("a5_condensation_signal", F.col("a5_bid_condensation") - F.col("a5_ask_condensation"))


def impact_depth(df: DataFrame, order_size: Column, lag: int = 20, keys=SESSION) -> DataFrame:
    """a6: the level at which an order of this size is filled, and how it changes."""
    w = session(*keys)
    df = df.withColumn("_size", order_size)

    def level(s: str) -> Column:
        # Levels whose running total falls short; the order ends on the next one, at most the last.
        short = F.aggregate(
            f"{s}_qty",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")),
            lambda acc, q: F.struct((acc["sum"] + q).alias("sum"), (acc["n"] + F.when(acc["sum"] + q < F.col("_size"), 1).otherwise(0)).alias("n")),
            lambda acc: acc["n"],
        )
        return F.least(short + 1, F.lit(LEVELS)).cast("double")

    df = df.withColumns({f"a6_{s}_impact_depth": level(s) for s in ("bid", "ask")}).drop("_size")
    df = df.withColumns({f"a6_{s}_shallowing": _since(F.col(f"a6_{s}_impact_depth"), lag, w) for s in ("bid", "ask")})
    thin = (F.col("a6_bid_shallowing") < -2) | (F.col("a6_ask_shallowing") < -2)
    return df.withColumn("a6_thin_book", F.coalesce(thin, F.lit(False)))


def microprice(df: DataFrame) -> DataFrame:
    """micro_deviation of the first level, from scalars or from level arrays."""
    level = (lambda c: F.col(c)[0]) if "bid_price" in df.columns else None
    price = (lambda s: level(f"{s}_price")) if level else F.col
    qty = (lambda s: level(f"{s}_qty")) if level else (lambda s: F.col(f"{s}_qty"))
    return df.withColumn("micro_deviation", micro_deviation(price("bid"), qty("bid"), price("ask"), qty("ask")))


def micro_signal(df: DataFrame) -> DataFrame:
    """The live variant: 0 where there is no size, and no guard added to the total."""
    n = (F.col("bid_qty") + F.col("ask_qty")).cast("double")
    value = (F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty")) / n - (F.col("bid") + F.col("ask")) / 2
    return df.withColumn("micro_signal", F.when(n < EPS, 0.0).otherwise(value))


def flow_levels(df: DataFrame, levels: int = 10, decay: float = 0.5, keys=SESSION) -> DataFrame:
    """Order flow imbalance of the first levels, weights falling by `decay`; 0 in the first row."""
    w = session(*keys)
    names = ("bid_price", "bid_qty", "ask_price", "ask_qty")
    df = df.withColumns({f"_{n}": F.lag(n).over(w) for n in names})
    out = F.lit(0.0)
    for k in range(levels):
        c = {n: F.col(n)[k] for n in names} | {f"_{n}": F.col(f"_{n}")[k] for n in names}
        out = out + decay**k * (flow(c["bid_price"], c["bid_qty"], c["_bid_price"], c["_bid_qty"]) - flow(c["ask_price"], c["ask_qty"], c["_ask_price"], c["_ask_qty"], -1))
    return df.withColumn("ofi_ml", F.when(F.row_number().over(w) == 1, 0.0).otherwise(out)).drop(*[f"_{n}" for n in names])


def flow_first(df: DataFrame, keys=SESSION) -> DataFrame:
    """Order flow imbalance of the first level, from scalar columns."""
    w = session(*keys)
    before = lambda c: F.lag(c).over(w)
    value = flow(F.col("bid"), F.col("bid_qty"), before("bid"), before("bid_qty")) - flow(F.col("ask"), F.col("ask_qty"), before("ask"), before("ask_qty"), -1)
    return df.withColumn("ofi_l1", F.when(F.row_number().over(w) == 1, 0).otherwise(value))


def tick_through(df: DataFrame, ticks: int = 2, n: int = 50, tick: float = TICK, keys=SESSION) -> DataFrame:
    """Sign of moves of at least so many ticks, and their rolling sum over a full window."""
    w = session(*keys)
    move = F.coalesce(F.col("mid") - F.lag("mid").over(w), F.lit(0.0))
    df = df.withColumn("tick_through", F.when(F.abs(move) >= ticks * tick, F.signum(move)).otherwise(0.0))
    frame = rolling(w, n)
    return df.withColumn("tick_through_sum", gated(F.sum("tick_through").over(frame), F.col("tick_through"), frame, n))


def stability(df: DataFrame, n: int = 20, tick: float = TICK, keys=SESSION) -> DataFrame:
    """Range of the mid in ticks over the variation of the first level's size, each side."""
    frame = rolling(session(*keys), n)
    span = (F.max("mid").over(frame) - F.min("mid").over(frame)) / tick
    one = lambda s: span / (F.stddev_samp(f"{s}_qty").over(frame) / (F.avg(f"{s}_qty").over(frame) + EPS) + 1e-3)
    df = df.withColumns({f"l1_stab_{s}": gated(one(s), F.col("mid"), frame, n) for s in ("bid", "ask")})
    return df.withColumn("l1_stab_signal", F.col("l1_stab_bid") - F.col("l1_stab_ask"))


def resonance(pair: DataFrame) -> DataFrame:
    """a7: cosine of two symbols' size vectors, each side and their mean; columns end in _a and _b."""
    c = lambda s: cosine(_double(f"{s}_qty_a"), _double(f"{s}_qty_b"))
    df = pair.withColumns({f"a7_{s}_resonance": c(s) for s in ("bid", "ask")})
    return df.withColumn("a7_resonance", (F.col("a7_bid_resonance") + F.col("a7_ask_resonance")) / 2)


def resonance_z(df: DataFrame, n: int = 200, least: int = 10, keys=("date",)) -> DataFrame:
    """a7_resonance_z: the resonance's distance from its rolling mean, in deviations."""
    return df.withColumn("a7_resonance_z", zscore(F.col("a7_resonance"), session(*keys), n, least))


def composite(df: DataFrame, n: int = 100, least: int = 20, keys=SESSION) -> DataFrame:
    """Structural composite before smoothing: z(a6 ask) - z(a6 bid) + z(a5)."""
    w = session(*keys)
    z = lambda c: zscore(F.col(c), w, n, least)
    return df.withColumn("composite_raw", z("a6_ask_shallowing") - z("a6_bid_shallowing") + z("a5_condensation_signal"))


def flow_composite(df: DataFrame, n: int = 100, least: int = 20, keys=SESSION) -> DataFrame:
    """Flow composite before smoothing: 3 z(micro) + z(flow) + z(a6 ask) - z(a6 bid)."""
    w = session(*keys)
    z = lambda c: zscore(F.col(c), w, n, least)
    return df.withColumn("flow_raw", 3 * z("micro_deviation") + z("ofi_ml") + z("a6_ask_shallowing") - z("a6_bid_shallowing"))


def forward(df: DataFrame, horizons: tuple[int, ...], ratio: bool = True, keys=SESSION) -> DataFrame:
    """Return, or difference, of the mid after so many rows."""
    w = session(*keys)
    ahead = lambda h: F.lead("mid", h).over(w)
    return df.withColumns({f"fwd_{h}": F.try_divide(ahead(h), F.col("mid")) - 1 if ratio else ahead(h) - F.col("mid") for h in horizons})
