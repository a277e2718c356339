"""Regimes of windows of packets, and mean-reverting pairs. All in DataFrame functions but the rescaled range."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.columns import normal_cdf

from .evaluation import at_ranks


def blocks(df: DataFrame, size: int, least: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """df with `block` (number of its window) and `i` (place in it); a tail below `least` rows goes."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq")) - 1
    b = df.withColumns({"block": F.floor(rn / size), "i": (rn % size).cast("int")})
    return b.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "block"))).filter(F.col("_n") >= least).drop("_n")


def variance_ratio(df: DataFrame, keys: tuple[str, ...], q: int, price: str = "mid") -> DataFrame:
    """keys, n returns, drift, vol and vr of log returns, the q-sums overlapping; vr is null without variance."""
    w = Window.partitionBy(*keys).orderBy("i")
    r = df.withColumn("_r", F.ln(price) - F.ln(F.lag(price).over(w)))
    whole = F.count("_r").over(w.rowsBetween(-(q - 1), 0)) == q
    r = r.withColumn("_q", F.when(whole, F.sum("_r").over(w.rowsBetween(-(q - 1), 0))))
    g = r.groupBy(*keys).agg(
        F.count("_r").alias("n"), F.sum("_r").alias("drift"), F.var_pop("_r").alias("_v"), F.var_pop("_q").alias("_vq"), (F.stddev_pop("_r") * F.sqrt(F.count("_r"))).alias("vol")
    )
    return g.withColumn("vr", F.when((F.col("n") >= q + 1) & (F.col("_v") > 0), F.col("_vq") / (q * F.col("_v")))).drop("_v", "_vq")


def rescaled_range(x: np.ndarray, least: int = 8) -> float | None:
    """The exponent of one series: slope of the log mean range over deviation on the log of the window, windows doubling to n / 2."""
    n = len(x)
    widths, means = [], []
    w = least
    while w <= n // 2:
        part = x[: n // w * w].reshape(-1, w)
        walk = np.cumsum(part - part.mean(axis=1, keepdims=True), axis=1)
        sd = part.std(axis=1)
        some = sd > 0
        if some.any():
            widths.append(w)
            means.append(((walk.max(axis=1) - walk.min(axis=1))[some] / sd[some]).mean())
        w *= 2
    if len(widths) < 2:
        return None
    return float(np.polyfit(np.log(widths), np.log(means), 1)[0])


def hurst(df: DataFrame, keys: tuple[str, ...], price: str = "mid", least: int = 8) -> DataFrame:
    """Rescaled-range exponent of the log price levels of each window of packets, at all scales up to half of it.

    A window is one group: its prices are sent once, in any order.
    """
    import pyarrow as pa

    lean = df.select(*keys, "i", F.ln(price).alias("_x"))
    schema = ", ".join([*(f"`{k}` {lean.schema[k].dataType.simpleString()}" for k in keys), "hurst double"])

    def run(window: pa.Table) -> pa.Table:
        x = window.sort_by("i").column("_x").drop_null().to_numpy()
        return pa.table([*window.select(list(keys)).slice(0, 1).columns, pa.array([rescaled_range(x, least)], pa.float64())], names=[*keys, "hurst"])

    return lean.groupBy(*keys).applyInArrow(run, schema)


def classify(df: DataFrame, keys: tuple[str, ...], q: int = 10, reverting: float = 0.7, trending: float = 1.5, price: str = "mid", with_hurst: bool = False) -> DataFrame:
    """keys, n, vr, drift_vol and regime of each window, `unknown` with too few rows; with_hurst adds hurst.

    The exponent doesn't decide the regime.
    """
    v = variance_ratio(df, keys, q, price)
    if with_hurst:
        v = v.join(hurst(df, keys, price), list(keys), "left")
    v = v.withColumn("drift_vol", F.when(F.col("vol") > 0, F.col("drift") / F.col("vol")).otherwise(0.0))
    label = (
        F.when(F.col("n") < q + 1, "unknown")
        .when(F.abs("drift_vol") >= trending, F.when(F.col("drift") > 0, "trend_up").otherwise("trend_down"))
        .when(F.col("vr") <= reverting, "mean_revert")
        .otherwise("chop")
    )
    return v.withColumn("regime", label).drop("drift", "vol")


def pair_fit(pairs: DataFrame, keys: tuple[str, ...] = ("x", "y"), a: str = "la", b: str = "lb") -> DataFrame:
    """keys, n, alpha and beta of the regression of a on b."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(a, b).alias("beta"), F.regr_intercept(a, b).alias("alpha"))


def spread(pairs: DataFrame, keys: tuple[str, ...] = ("x", "y"), fit: DataFrame | None = None) -> DataFrame:
    """pairs with the residual `s`; the fit is of the whole sample unless another is given."""
    f = pair_fit(pairs, keys) if fit is None else fit
    return pairs.join(f.select(*keys, "alpha", "beta"), list(keys)).withColumn("s", F.col("la") - (F.col("alpha") + F.col("beta") * F.col("lb")))


def rolling_beta_drift(pairs: DataFrame, keys: tuple[str, ...] = ("x", "y"), order: str = "hour", n: int = 120, a: str = "la", b: str = "lb") -> DataFrame:
    """keys and beta_drift: the deviation of the rolling regression slope of a on b over n rows."""
    f = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    beta = F.when(F.count("*").over(f) >= n, F.try_divide(F.covar_samp(a, b).over(f), F.var_samp(b).over(f)))
    return pairs.select(*keys, beta.alias("_beta")).groupBy(*keys).agg(F.stddev_samp("_beta").alias("beta_drift"))


def pair_screen(pairs: DataFrame, split: float = 0.6, window: int = 120, alpha: float = 0.05, least: tuple[int, int, int] = (500, 300, 200), order: str = "hour") -> DataFrame:
    """Pairs(x, y, order, la, lb) tested in the first `split` of all times and in the rest.

    Columns: x, y, n, beta_in, beta_out, p_in, p_out, beta_drift, corr (of changes) and kept (both p below
    alpha). Pairs with fewer rows than `least` (of all, in, out) are left out.
    """
    keys = ("x", "y")
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    times = pairs.select(micros.alias("_at")).distinct().withColumn("_all", F.lit(1))  # a row a time, as many as bars
    # The last of the first int(split x n) times; none where there are none.
    cut = at_ranks(times, ("_all",), "_at", {"_cut": (split, lambda n: F.floor(n * split) - 1)}).select("_cut")
    halves = pairs.withColumn("half", F.when(micros <= cut.scalar(), "in").otherwise("out"))
    by = (*keys, "half")
    fit = pair_fit(halves, by)
    test = dickey_fuller(spread(halves, by, fit), by, order).select(*by, "adf_p")
    wide = fit.join(test, list(by), "left").groupBy(*keys).pivot("half", ["in", "out"]).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.first("adf_p").alias("p"))
    w = Window.partitionBy(*keys).orderBy(order)
    moves = pairs.select(*keys, (F.col("la") - F.lag("la").over(w)).alias("_a"), (F.col("lb") - F.lag("lb").over(w)).alias("_b"))
    moves = moves.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("corr"))
    out = moves.join(wide, list(keys)).join(rolling_beta_drift(pairs, keys, order, window), list(keys))
    out = out.filter((F.col("n") >= least[0]) & (F.col("in_n") >= least[1]) & (F.col("out_n") >= least[2]))
    kept = (F.col("in_p") < alpha) & (F.col("out_p") < alpha)
    return out.select(*keys, "n", F.col("in_beta").alias("beta_in"), F.col("out_beta").alias("beta_out"), F.col("in_p").alias("p_in"), F.col("out_p").alias("p_out"), "beta_drift", "corr", kept.alias("kept"))


def dickey_fuller(df: DataFrame, keys: tuple[str, ...], order: str, value: str = "s") -> DataFrame:
    """t statistic and p-value of the unit-root test with one lag and a constant.

    The change is regressed on the level before and the change before, by their centred sums.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, F.col(value).alias("_s")).withColumn("_l", F.lag("_s").over(w))
    d = d.withColumn("_y", F.col("_s") - F.col("_l")).withColumn("_p", F.lag("_y").over(w)).filter("_p IS NOT NULL")
    c = lambda p, q: F.covar_pop(p, q) * F.count("*")
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), *[c(p, q).alias(p + q) for p, q in (("_l", "_l"), ("_p", "_p"), ("_l", "_p"), ("_l", "_y"), ("_p", "_y"), ("_y", "_y"))])
    det = F.col("_l_l") * F.col("_p_p") - F.col("_l_p") * F.col("_l_p")
    b1 = F.try_divide(F.col("_l_y") * F.col("_p_p") - F.col("_p_y") * F.col("_l_p"), det)
    b2 = F.try_divide(F.col("_p_y") * F.col("_l_l") - F.col("_l_y") * F.col("_l_p"), det)
    rss = F.col("_y_y") - b1 * F.col("_l_y") - b2 * F.col("_p_y")
    t = F.try_divide(b1, F.sqrt(F.try_divide(F.try_divide(rss, F.col("n") - 3) * F.col("_p_p"), det)))
    return m.select(*keys, "n", F.when(F.col("n") > 3, t).alias("adf_t")).withColumn("adf_p", unit_root_p(F.col("adf_t")))


def unit_root_p(t: Column) -> Column:
    """Approximate p-value of the unit-root t with a constant (published response surface)."""
    # The surface's bounds and coefficients.
    low, turn, high = -18.83, -1.61, 2.74
    small = 2.1659 + 1.4412 * t + 0.038269 * t * t
    large = 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t
    return F.when(t > high, 1.0).when(t < low, 0.0).otherwise(normal_cdf(F.when(t <= turn, small).otherwise(large)))


def ou_fit(df: DataFrame, keys: tuple[str, ...], order: str, value: str = "s", step: float = 1.0) -> DataFrame:
    """Mean reversion of a series from its regression on itself a step before.

    b is held to [1e-6, 0.999999]; sigma_eq is the residuals' population deviation over sqrt(1 - b^2).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, F.col(value).alias("_y"), F.lag(value).over(w).alias("_x")).filter("_x IS NOT NULL")
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_c"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"), F.covar_pop("_x", "_y").alias("_cxy"))
    g = g.withColumn("b", F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), F.col("_b"))))
    theta = -F.ln("b") / step
    residual = F.col("_vy") - 2 * F.col("b") * F.col("_cxy") + F.col("b") * F.col("b") * F.col("_vx")
    return g.select(*keys, "n", "b", theta.alias("theta"), (math.log(2) / theta).alias("half_life"), (F.col("_c") / (1 - F.col("b"))).alias("mu"), F.sqrt(residual / (1 - F.col("b") * F.col("b"))).alias("sigma_eq"))
