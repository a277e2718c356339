"""Column functions that the operators share. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Added to denominators, as a guard that keeps a ratio defined.
EPS = 1e-9
SESSION = ("symbol", "date")


def session(*keys: str, order: tuple[str, ...] = ("ts", "seq")):
    """Rows of a session in their total order."""
    return Window.partitionBy(*(keys or SESSION)).orderBy(*order)


def rolling(window, n: int):
    """The current row and the n - 1 before it."""
    return window.rowsBetween(-(n - 1), 0)


def gated(value: Column, counted: Column, frame, least: int) -> Column:
    """value, where the frame holds at least `least` values of `counted` that aren't null."""
    return F.when(F.count(counted).over(frame) >= least, value)


def zscore(x: Column, window, n: int, least: int | None = None, eps: float = EPS) -> Column:
    """Rolling z-score with the sample deviation; a deviation below 1e-12 counts as 0."""
    frame = rolling(window, n)
    sd = F.stddev_samp(x).over(frame)
    sd = F.when(sd < 1e-12, 0.0).otherwise(sd)
    return gated((x - F.avg(x).over(frame)) / (sd + eps), x, frame, n if least is None else least)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two arrays, each shifted by EPS and normalised."""
    p, q = F.transform(p, lambda x: x + EPS), F.transform(q, lambda x: x + EPS)
    sp, sq = total(p), total(q)
    return total(F.zip_with(p, q, lambda x, y: x / sp * F.ln((x / sp) / (y / sq))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPS)


def micro_deviation(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """Size-weighted price less the mid."""
    return (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty + EPS) - (bid + ask) / 2


def flow(price: Column, qty: Column, before: Column, qty_before: Column, up: int = 1) -> Column:
    """Order flow of a level since the last packet; up is 1 for bids, -1 for asks."""
    better, worse = (price > before, price < before) if up > 0 else (price < before, price > before)
    return F.when(better, qty).when(worse, -qty_before).otherwise(qty - qty_before)


# The exchange's and the broker's charges.
BROKERAGE, EXCHANGE, TURNOVER, TRANSACTION_TAX, STAMP, SERVICE_TAX = 20.0, 0.00002, 0.000001, 0.000125, 0.00002, 0.18


def round_trip_fee(entry: Column, exit_: Column, qty: Column, direction: Column) -> Column:
    """Charges of buying and selling `qty`, whichever comes first."""
    buy = F.when(direction > 0, entry).otherwise(exit_) * qty
    sell = F.when(direction > 0, exit_).otherwise(entry) * qty
    exchange, turnover = EXCHANGE * (buy + sell), TURNOVER * (buy + sell)
    return 2 * BROKERAGE + exchange + turnover + TRANSACTION_TAX * sell + STAMP * buy + SERVICE_TAX * (2 * BROKERAGE + exchange + turnover)


def slipped(mid: Column, direction: Column, entry: bool, ticks: float = 1.0, tick: float = 0.05) -> Column:
    """The price a taker gets: worse than the mid by some ticks."""
    return mid + (1 if entry else -1) * direction * ticks * tick


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution by rational approximations (error below 1.2e-9)."""
    # The published coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x: Column, ks: tuple[float, ...]) -> Column:
        out = F.lit(ks[0])
        for k in ks[1:]:
            out = out * x + k
        return out

    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < 0.02425, poly(low, c) / (poly(low, d) * low + 1))
        .when(p > 1 - 0.02425, -poly(high, c) / (poly(high, d) * high + 1))
        .otherwise(poly(r, a) * q / (poly(r, b) * r + 1))
    )


def normal_cdf(z: Column) -> Column:
    """The normal distribution, by a series near 0 and a continued fraction beyond (error below 1e-12)."""
    x = F.abs(z)
    steps = lambda n: F.sequence(F.lit(n), F.lit(1))
    series = x * F.aggregate(steps(40), F.lit(1.0), lambda a, k: 1 + a * x * x / (2 * k + 1))
    fraction = F.aggregate(steps(24), x, lambda a, k: x + k / a)
    dens = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    upper = F.when(x < 3, 0.5 - dens * series).otherwise(dens / fraction)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def drawn(text: Column) -> Column:
    """A number below 2 ** 32 that follows from a text and looks random: the same in every run and engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mean_rank(window_keys: list, value: Column) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*window_keys).orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # in the same window as the rank
    return F.rank().over(w) + (ties - 1) / 2


def correlation(x, y) -> Column:
    """Pearson correlation of two columns without nulls, as an aggregate; null where one is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
