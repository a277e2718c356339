"""The normal distribution, overfitting splits and resampling as DuckDB expressions, for the queries' SQL."""

from __future__ import annotations

from itertools import combinations

# The published coefficients of the inverse, as in tidebook.functions.columns.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: str, ks: tuple[float, ...]) -> str:
    out = f"{ks[0]!r}::DOUBLE"
    for k in ks[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def ppf(p: str) -> str:
    """Inverse of the normal distribution at the column p; null outside (0, 1)."""
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {_poly(low, _C)} / ({_poly(low, _D)} * {low} + 1)"
        f" WHEN {p} > 1 - 0.02425 THEN -{_poly(high, _C)} / ({_poly(high, _D)} * {high} + 1) ELSE {_poly(r, _A)} * {q} / ({_poly(r, _B)} * {r} + 1) END)"
    )


def cdf(z: str) -> str:
    """The normal distribution at the column z."""
    steps = lambda n: f"list_transform(range({n}, 0, -1), lambda j: j::DOUBLE)"
    series = f"abs({z}) * list_reduce([1.0::DOUBLE] || {steps(40)}, lambda a, k: 1 + a * {z} * {z} / (2 * k + 1))"
    fraction = f"list_reduce([abs({z})::DOUBLE] || {steps(24)}, lambda a, k: abs({z}) + k / a)"
    density = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"
    upper = f"(CASE WHEN abs({z}) < 3 THEN 0.5 - {density} * {series} ELSE {density} / {fraction} END)"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END)"


def splits(blocks: int) -> str:
    return ", ".join(f"({i}, {list(c)})" for i, c in enumerate(combinations(range(blocks), blocks // 2)))


def overfit(source: str, arm: str = "arm", day: str = "day", value: str = "pnl", blocks: int = 6) -> str:
    """CTEs up to pb(n_splits, pbo, median_logit): probability of backtest overfitting of source(arm, day, value)."""
    arms = f"(SELECT count(DISTINCT {arm}) FROM {source})"
    return f""", whole AS (SELECT {day} FROM {source} WHERE {value} IS NOT NULL GROUP BY {day} HAVING count(*) = {arms}),
    sz AS (SELECT count(*) // {blocks} AS size FROM whole), bl AS (SELECT {day}, (row_number() OVER (ORDER BY {day}) - 1) // (SELECT size FROM sz) AS block FROM whole),
    su AS (SELECT {arm} AS a, block, sum({value}) AS total FROM {source} JOIN bl USING ({day}) WHERE block < {blocks} GROUP BY ALL), sp AS (SELECT * FROM (VALUES {splits(blocks)}) x(split, inside)),
    pf AS (SELECT split, a, sum(CASE WHEN list_contains(inside, block) THEN total ELSE 0 END) AS i, sum(CASE WHEN list_contains(inside, block) THEN 0 ELSE total END) AS o FROM su, sp GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i DESC, a) AS best, (rank() OVER (PARTITION BY split ORDER BY o) + (count(*) OVER (PARTITION BY split, o) - 1) / 2) / ({arms} + 1) AS om FROM pf),
    lo AS (SELECT ln(om / (1 - om)) AS logit FROM rk WHERE best = 1),
    pb AS (SELECT count(*) AS n_splits, avg(CASE WHEN logit <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo, median(logit) AS median_logit FROM lo)"""


def drawn(text: str) -> str:
    """A number below 2 ** 32 that follows from a text, as tidebook.functions.columns.drawn."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def resampled(source: str, value: str, draws: int, block: int, statistic: str, by: str = "arm", order: str = "day", seed: int = 0) -> str:
    """CTEs up to bs(by, low, high, p_gt0): the interval of a statistic of resampled circular blocks of source."""
    found = "list_avg(v)" if statistic == "mean" else "CASE WHEN list_aggregate(v, 'stddev_samp') > 0 THEN list_avg(v) / list_aggregate(v, 'stddev_samp') ELSE 0 END"
    at = f"({drawn(f"'{seed}-' || b || '-' || (i // {block})")} % len(xs) + i % {block}) % len(xs) + 1"
    return f""", xs AS (SELECT {by}, list({value} ORDER BY {order}) AS xs FROM {source} GROUP BY {by}), xb AS (SELECT {by}, xs, unnest(range({draws})) AS b FROM xs),
    xv AS (SELECT {by}, b, list_transform(range(len(xs)), lambda i: xs[({at})::INT]) AS v FROM xb), xm AS (SELECT {by}, {found} AS m FROM xv),
    bs AS (SELECT {by}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_gt0 FROM xm GROUP BY {by})"""
