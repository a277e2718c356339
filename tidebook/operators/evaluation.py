"""Evaluation of signals and of closed trades."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.columns import EPS, correlation, drawn, mean_rank, normal_cdf, normal_ppf


#: Of the quantile sketch: its ranks are off by a key's rows / ACCURACY at most. Keys of fewer rows are sorted whole.
ACCURACY = 10_000


def at_ranks(df: DataFrame, keys: tuple[str, ...], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, total (rows with a value) and by name the value at a rank, exactly.

    wanted names a share (0 to 1) and the rank, from 0, as a function of the total; a rank may be two away from share * total
    at most. A sketch of each key brackets the ranks: only values within a bracket, some 0.06 % of a
    key's rows for each, are told apart and put in order, and what lies between is counted. Nulls don't count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    shares = sorted({share for share, _ in wanted.values()})
    margin = 3 / ACCURACY
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.percentile_approx("v", [max(0.0, s - margin) for s in shares], ACCURACY).alias("_low"),
        F.percentile_approx("v", [min(1.0, s + margin) for s in shares], ACCURACY).alias("_high"),
    )
    few = F.col("total") <= ACCURACY
    lows = [F.when(few | F.lit(s - margin <= 0), float("-inf")).otherwise(F.col("_low")[i]) for i, s in enumerate(shares)]
    highs = [F.when(few | F.lit(s + margin >= 1), float("inf")).otherwise(F.col("_high")[i]) for i, s in enumerate(shares)]
    held = sketch.select(*keys, *[c.alias(f"_l{i}") for i, c in enumerate(lows)], *[c.alias(f"_h{i}") for i, c in enumerate(highs)])
    near, passed = F.lit(False), F.lit(0)
    for i in range(len(shares)):
        near = near | ((F.col("v") >= F.col(f"_l{i}")) & (F.col("v") <= F.col(f"_h{i}")))
        passed = passed + (F.col("v") > F.col(f"_h{i}")).cast("int")
    joined = rows.join(held, list(keys)) if keys else rows.crossJoin(held)
    counted = joined.groupBy(*keys, passed.alias("_passed"), F.when(near, F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.max("v").alias("_top"))
    order = Window.partitionBy(*keys).orderBy("_top")
    counted = counted.withColumn("_at", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    counted = counted.join(sketch.select(*keys, "total"), list(keys)) if keys else counted.crossJoin(sketch.select("total"))

    def at(rank: Callable[[Column], Column]) -> Column:
        r = rank(F.col("total"))
        return F.max(F.when((F.col("_at") <= r) & (r < F.col("_at") + F.col("n")), F.col("v")))

    return counted.groupBy(*keys).agg(F.max("total").alias("total"), *[at(rank).alias(name) for name, (_, rank) in wanted.items()])


def percentiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and an exact interpolated percentile of value for each named share (0 to 1).

    No task holds a key's values at once (see at_ranks). Nulls in value don't count; keys that are null or without a value give no row.
    """

    def rank(share: float, side):
        return share, lambda total: side(share * (total - 1)).cast("long")

    found = at_ranks(df, keys, value, {f"{side.__name__}_{name}": rank(q, side) for name, q in shares.items() for side in (F.floor, F.ceil)})

    def point(name: str, q: float) -> Column:
        h, low, high = q * (F.col("total") - 1), F.col(f"floor_{name}"), F.col(f"ceil_{name}")
        return low + (high - low) * (h - F.floor(h))

    return found.select(*keys, *[point(name, q).alias(name) for name, q in shares.items()])


def _sorted(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows where x is known in the order of x, and x in that order."""
    at = np.flatnonzero(known)
    at = at[np.argsort(x[at], kind="stable")]
    return at, x[at]


def _mean_ranks(order: np.ndarray, values: np.ndarray, known: np.ndarray, out: np.ndarray) -> int:
    """Into out the ranks of the rows of `order` that are known, ties at their mean; returns how many they are."""
    on = known[order]
    at, v = order[on], values[on]
    if not len(at):
        return 0
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    out[at] = np.repeat(first + (size + 1) / 2, size)
    return len(at)


def rank_correlations(signals: list[tuple[np.ndarray, np.ndarray]], returns: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, float | None]]]:
    """(n, Spearman correlation) of each signal with each return, on the rows where both are known.

    Each is a pair (values, known). A column is sorted once; what is left of its order where the other side is
    known gives its ranks there. None where one side is constant.
    """
    rows = len(signals[0][0])
    ys = [(known, *_sorted(y, known)) for y, known in returns]
    rx, ry = np.zeros(rows), np.zeros(rows)
    out = []
    for x, has_x in signals:
        order_x, sorted_x = _sorted(x, has_x)
        line = []
        for has_y, order_y, sorted_y in ys:
            n = _mean_ranks(order_x, sorted_x, has_y, rx)
            _mean_ranks(order_y, sorted_y, has_x, ry)
            both = has_x & has_y
            a, b = rx[both] - (n + 1) / 2, ry[both] - (n + 1) / 2
            spread = np.sqrt(a @ a) * np.sqrt(b @ b)
            line.append((n, float(a @ b / spread) if spread > 0 else None))
        out.append(line)
    return out


def signal_ic(df: DataFrame, signals: tuple[str, ...], horizons: tuple[int, ...], keys: tuple[str, ...] = ("symbol", "date"), least: int = 50) -> DataFrame:
    """Spearman correlation of each signal with each forward return fwd_<h>, by keys (of which a session is one).

    On the rows where both are known, ties at their mean rank; null with fewer than `least` rows
    or where one side is constant. A session's columns are shuffled once and ranked side by side in one task: its
    rows times (signals + horizons) numbers. signal_ic_windows is for groups of any size.
    """
    import pyarrow as pa

    lean = df.select(*keys, *[F.col(s).cast("double").alias(f"_x{i}") for i, s in enumerate(signals)], *[F.col(f"fwd_{h}").cast("double").alias(f"_y{i}") for i, h in enumerate(horizons)])
    kinds = [lean.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "signal string, horizon int, n long, ic double"])

    def run(session: pa.Table) -> pa.Table:
        def side(name: str, n: int) -> list:
            columns = [session.column(f"{name}{i}").combine_chunks() for i in range(n)]
            return [(c.to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)) for c in columns]

        found = rank_correlations(side("_x", len(signals)), side("_y", len(horizons)))
        made = [(s, h, n, ic if n >= least else None) for s, line in zip(signals, found) for h, (n, ic) in zip(horizons, line) if n]
        head = session.select(list(keys)).slice(0, 1).take(pa.array([0] * len(made), pa.int64()))
        rest = zip(*made) if made else [()] * 4
        types = (pa.string(), pa.int32(), pa.int64(), pa.float64())
        return pa.table([*head.columns, *(pa.array(list(c), t) for c, t in zip(rest, types))], names=[*keys, "signal", "horizon", "n", "ic"])

    return lean.groupBy(*keys).applyInArrow(run, schema)


def signal_ic_windows(df: DataFrame, signals: tuple[str, ...], horizons: tuple[int, ...], keys: tuple[str, ...] = ("symbol", "date"), least: int = 50) -> DataFrame:
    """signal_ic by windows, for groups too large for one task: rows are copied once a signal and horizon, and then ranked."""
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals])).alias("s"),
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in horizons]).alias("ys"),
    )
    long = long.select(*keys, "s.*", F.inline("ys")).filter("x IS NOT NULL AND y IS NOT NULL")
    group = [*keys, "signal", "horizon"]
    ranked = long.repartition(*group).select(*group, mean_rank(group, F.col("x")).alias("rx"), mean_rank(group, F.col("y")).alias("ry"))
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("ic"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    return out.select(*group, "n", F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("ic")).alias("ic"))


def ic_summary(ic: DataFrame, by: tuple[str, ...] = ("signal", "horizon")) -> DataFrame:
    """Mean, deviation, information ratio and share of positive ICs."""
    ic = ic.filter("ic IS NOT NULL")
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        (F.avg("ic") / (F.stddev_samp("ic") + EPS)).alias("icir"),
        F.avg(F.when(F.col("ic") > 1e-12, 1.0).otherwise(0.0)).alias("pct_pos"),
        F.count("*").alias("n"),
    )


def _where(c: Column, value: str = "net_pnl") -> Column:
    return F.sum(F.when(c, F.col(value)).otherwise(0.0))


def trade_metrics(trades: DataFrame, *by: str) -> DataFrame:
    """Count, sums, win rate and profit factor of closed trades; the factor is infinite without losses."""
    losses = -_where(F.col("net_pnl") < 0)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.sum("net_pnl").alias("net"),
        F.sum("gross_pnl").alias("gross"),
        F.sum("fee").alias("fees"),
        F.avg(F.when(F.col("net_pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.when(losses > 0, _where(F.col("net_pnl") > 0) / losses).otherwise(F.lit(float("inf"))).alias("profit_factor"),
    )


def day_metrics(trades: DataFrame, *by: str) -> DataFrame:
    """What a day's log says: losses count from 0 down, and payoff is mean win over mean loss or 0."""
    win, loss = F.col("net_pnl") > 0, F.col("net_pnl") <= 0
    wins, losses = F.count(F.when(win, 1)), F.count(F.when(loss, 1))
    mean_win, mean_loss = F.coalesce(F.avg(F.when(win, F.col("net_pnl"))), F.lit(0.0)), F.coalesce(F.avg(F.when(loss, F.col("net_pnl"))), F.lit(0.0))
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.sum("net_pnl").alias("net"),
        mean_win.alias("avg_win"),
        mean_loss.alias("avg_loss"),
        F.when(mean_loss != 0, mean_win / F.abs(mean_loss)).otherwise(0.0).alias("payoff"),
        F.max("net_pnl").alias("best"),
        F.min("net_pnl").alias("worst"),
    )


def drawdown(df: DataFrame, value: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Least of the cumulative value less its running maximum; the first row is the first peak."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("_cum", F.sum(value).over(w)).withColumn("_peak", F.max("_cum").over(w))
    return cum.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_peak")).alias("max_drawdown"))


def sharpe(daily: DataFrame, *by: str, value: str = "pnl", days: int | None = None) -> DataFrame:
    """Mean over deviation. With `days` it is annualised, guarded by EPS, and null below two rows;
    else it is per period, and 0 where the deviation is."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    if days:
        out = F.when(n >= 2, mean / (sd + EPS) * F.sqrt(F.lit(float(days))))
    else:
        out = F.when((n < 2) | (sd == 0), 0.0).otherwise(mean / sd)
    return daily.groupBy(*by).agg(out.alias("sharpe"))


def run_summary(trades: DataFrame, *by: str, day: str = "date", days: int = 252) -> DataFrame:
    """Trade metrics, annualised Sharpe of daily results and drawdown, from one pass over the trades.

    Trades are summed by day first; all else is worked out from the days.
    """
    net = F.col("net_pnl")
    d = trades.groupBy(*by, day).agg(
        F.count("*").alias("_n"),
        F.sum(net).alias("_net"),
        F.sum("gross_pnl").alias("_gross"),
        F.sum("fee").alias("_fee"),
        F.count_if(net > 0).alias("_wins"),
        F.sum(F.when(net > 0, net).otherwise(0.0)).alias("_won"),
        F.sum(F.when(net < 0, -net).otherwise(0.0)).alias("_lost"),
    )
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cum", F.sum("_net").over(w)).withColumn("_down", F.col("_cum") - F.max("_cum").over(w))
    lost = F.sum("_lost")
    return d.groupBy(*by).agg(
        F.sum("_n").alias("n_trades"),
        F.count("*").alias("n_days"),
        F.sum("_net").alias("net"),
        F.sum("_gross").alias("gross"),
        F.sum("_fee").alias("fees"),
        (F.sum("_wins") / F.sum("_n")).alias("win_rate"),
        F.when(lost > 0, F.sum("_won") / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.when(F.count("*") >= 2, F.avg("_net") / (F.stddev_samp("_net") + EPS) * F.sqrt(F.lit(float(days)))).alias("sharpe"),
        F.min("_down").alias("max_drawdown"),
    )


def moments(daily: DataFrame, *by: str, value: str = "pnl") -> DataFrame:
    """n, n_days (values that aren't 0), per-period Sharpe, bias-corrected skewness, and bias-corrected kurtosis plus 3."""
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)
    sd = F.stddev_samp(value)
    return daily.groupBy(*by).agg(F.count(value).alias("n"), F.count(F.when(F.col(value) != 0, 1)).alias("n_days"), F.when(sd > 0, F.avg(value) / sd).otherwise(0.0).alias("sharpe"), skew.alias("skew"), kurt.alias("kurt"))


def psr(sr: Column, n: Column, skew: Column, kurt: Column, star: Column) -> Column:
    """Probability that the true Sharpe exceeds `star`; null where it isn't defined."""
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when((n >= 2) & (spread > 0), normal_cdf((sr - star) * F.sqrt(n - 1.0) / F.sqrt(spread)))


EULER = 0.5772156649015329
E = 2.718281828459045


def expected_best(sd: Column, trials: Column) -> Column:
    """Expected greatest Sharpe of so many trials without skill; 0 below two trials."""
    first, second = normal_ppf(1 - 1 / trials), normal_ppf(1 - 1 / (trials * E))
    return F.when((trials < 2) | (sd <= 0) | sd.isNull(), 0.0).otherwise(sd * ((1 - EULER) * first + EULER * second))


def deflated(daily: DataFrame, arm: str = "arm", value: str = "pnl", every_day: bool = False, normal: bool = False) -> DataFrame:
    """PSR and deflated Sharpe of each arm, n being its days with a result that isn't 0, or with every_day all.

    With `normal` the PSR against 0 takes a skewness of 0 and a kurtosis of 3. The arms are the trials (a
    single one is compared with a trial of 0): a summary row each, few enough for one row of totals.
    """
    m = moments(daily, arm, value=value)
    trials = m.agg(F.stddev_samp("sharpe").alias("_sd"), F.count("*").cast("double").alias("_n"), F.max("sharpe").alias("_one"))
    trials = trials.select(F.when(F.col("_n") == 1, F.abs("_one") / F.sqrt(F.lit(2.0))).otherwise(F.col("_sd")).alias("_sd"), F.greatest("_n", F.lit(2.0)).alias("_n"))
    m = m.crossJoin(F.broadcast(trials)).withColumn("sr_star", expected_best(F.col("_sd"), F.col("_n")))
    sr, n, skew, kurt = (F.col(c) for c in ("sharpe", "n" if every_day else "n_days", "skew", "kurt"))
    plain = (F.lit(0.0), F.lit(3.0)) if normal else (skew, kurt)
    return m.withColumns({"psr": psr(sr, n, *plain, F.lit(0.0)), "dsr": psr(sr, n, skew, kurt, F.col("sr_star"))}).drop("_sd", "_n")


def pbo(matrix: DataFrame, arm: str = "arm", day: str = "day", value: str = "pnl", blocks: int = 6) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    matrix is long; days that an arm lacks go. There are `blocks` blocks, or the even number that the
    days allow; they are of equal length (a tail goes), and each split's means come from block sums, so
    the splits cost a re-aggregation of blocks x arms. All is one plan: the numbers of arms and days
    are rows of it. Without two days there is no split.
    """
    matrix = matrix.select(arm, day, value)
    arms = matrix.agg(F.countDistinct(arm).alias("_arms"))
    whole = matrix.filter(F.col(value).isNotNull()).groupBy(day).agg(F.count("*").alias("_n"))
    whole = whole.crossJoin(F.broadcast(arms)).filter(F.col("_n") == F.col("_arms")).select(day, "_arms")
    every = Window.partitionBy("_arms")  # days are few, and their number is a row's own
    days = F.count("*").over(every)
    s = F.least(F.lit(blocks // 2 * 2), F.floor(days / 2) * 2)
    place = whole.withColumns({"_s": s, "_size": F.floor(F.try_divide(days, s)), "_i": F.row_number().over(every.orderBy(day)) - 1})
    place = place.filter("_s >= 2").withColumn("block", F.floor(F.try_divide(F.col("_i"), F.col("_size"))).cast("int")).filter("block < _s")
    sums = matrix.join(place, day).groupBy(arm, "block", "_s", "_size", "_arms").agg(F.sum(value).alias("total"))
    splits = [(n, i, list(c)) for n in range(2, blocks + 1, 2) for i, c in enumerate(combinations(range(n), n // 2))]
    table = F.broadcast(matrix.sparkSession.createDataFrame(splits, "_s long, split int, inside array<int>"))
    half = F.first(F.col("_size") * F.col("_s") / 2)
    inside = F.array_contains("inside", F.col("block"))
    perf = sums.join(table, "_s").groupBy("split", arm, "_arms").agg((F.sum(F.when(inside, F.col("total")).otherwise(0.0)) / half).alias("is_mean"), (F.sum(F.when(inside, 0.0).otherwise(F.col("total"))) / half).alias("oos_mean"))
    # Equal in-sample means: the first arm by name.
    best = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("is_mean"), arm))
    ranked = perf.withColumns({"best": best, "rank": mean_rank(["split"], F.col("oos_mean"))}).filter("best = 1")
    omega = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("rank") / (F.col("_arms") + 1)))
    logit = F.ln(omega / (1 - omega))
    return ranked.withColumn("logit", logit).agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("n_splits"), F.median("logit").alias("median_logit"))


def autocorrelation(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], lags: int, most: Callable[[Column], Column] | None = None) -> DataFrame:
    """rho by keys and lag 1..lags, about the mean of the whole series; 0 without variance or rows.

    most tells the last lag of a series from its number of rows, where that is less than lags.
    """
    w = Window.partitionBy(*keys)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(w))
    ordered = w.orderBy(*order)
    # One window for all lags: the values ahead as an array.
    ahead = F.collect_list("_d").over(ordered.rowsBetween(1, lags))
    d = d.withColumn("_ahead", ahead if most is None else F.slice(ahead, F.lit(1), F.greatest(most(F.count(value).over(w)), F.lit(0)).cast("int")))
    d = d.select(*keys, "_d", F.posexplode_outer("_ahead").alias("_i", "_x"))
    var = df.groupBy(*keys).agg(F.count(value).alias("n"), F.var_pop(value).alias("_v"))
    sums = d.filter("_i IS NOT NULL").groupBy(*keys, (F.col("_i") + 1).alias("lag")).agg(F.sum(F.col("_d") * F.col("_x")).alias("_s"))
    return var.join(sums, list(keys)).select(*keys, "lag", "n", F.when(F.col("_v") > 0, F.col("_s") / (F.col("n") * F.col("_v"))).otherwise(0.0).alias("rho"))


LAGS = 180


def effective_size(df: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """n / (1 + 2 sum of autocorrelations), the sum ending before the first that isn't positive.

    Lags go up to the lesser of n - 1 and int(10 log10 n) + 20, which LAGS bounds for series of up to 10 ** 16 rows.
    """
    last = lambda n: F.least(n - 1, F.floor(10 * F.log10(F.greatest(n, F.lit(1)))) + 20)
    rho = autocorrelation(df, value, keys, order, LAGS, last)
    rho = rho.filter(F.col("lag") <= last(F.col("n")))
    ended = F.max(F.when(F.col("rho") <= 0, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    total = rho.withColumn("_ended", ended).groupBy(*keys).agg(F.sum(F.when(F.col("_ended") == 0, F.col("rho")).otherwise(0.0)).alias("_s"))
    n = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return n.join(total, list(keys), "left").select(*keys, "n", F.when(F.col("n") < 3, F.col("n").cast("double")).otherwise(F.col("n") / (1 + 2 * F.coalesce("_s", F.lit(0.0)))).alias("n_eff"))


def bootstrap(pairs: DataFrame, by: tuple[str, ...], value: str, order: str, draws: int = 10_000, block: int = 1, seed: int = 0, statistic: str = "mean") -> DataFrame:
    """A statistic - the mean, or the Sharpe of a period - and its 95 % interval from resampled circular blocks.

    Columns: by, n, the statistic under its name (for the mean also its t), low, high and p_gt0, the share of draws above 0.
    Draw b takes, for each place of the series, the value at a place that a hash of (seed, b, block)
    chooses, so draws are the same in every run. Series are of days: one is an array, and each draw
    a row that resamples it, so n x draws values are made, spread over the draws. The interval of a
    Sharpe is null for fewer than block + 1 values.
    """
    series = pairs.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("_x")))), lambda r: r["_x"]).alias("_xs"))
    n = F.size("_xs")
    h = lambda i: drawn(F.concat_ws("-", F.lit(seed), F.col("_b"), F.floor(i / block)))
    place = lambda i: ((h(i) % n + i % block) % n).cast("int")
    # A few series and many draws: the draws are dealt over tasks in parts.
    parts = min(draws, 32)
    asked = series.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, *by, "_part")
    asked = asked.withColumn("_b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda b: b % parts == F.col("_part"))))
    asked = asked.select(*by, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_xs", place(i))).alias("_v"))

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    drawn_ = asked.withColumn("_m", mean(F.col("_v")))
    if statistic == "sharpe":
        sd = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / (F.size("_v") - 1))
        drawn_ = drawn_.withColumn("_m", F.when((F.size("_v") > 1) & (sd > 0), F.col("_m") / sd).otherwise(0.0))
    spread = drawn_.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("_m") > 0, 1.0).otherwise(0.0)).alias("p_gt0"))
    x, found = F.col(value), {}
    if statistic == "sharpe":
        found = {"sharpe": F.when((F.count(x) > 1) & (F.stddev_samp(x) > 0), F.avg(x) / F.stddev_samp(x)).otherwise(0.0)}
    else:
        found = {"mean": F.avg(x), "t": F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))}
    point = pairs.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in found.items()])
    out = point.join(spread, list(by))
    if statistic == "sharpe":
        out = out.withColumns({c: F.when(F.col("n") > block, F.col(c)) for c in ("low", "high", "p_gt0")})
    return out
