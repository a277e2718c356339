"""Closed trades held against the mid: markouts, what is left of a result at the mid, and live totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof


def trade_markouts(trades: DataFrame, quotes: DataFrame, horizons_s: tuple[int, ...], tolerance_s: int = 5, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """trades with mid_entry, mid_exit and mk_<h>: the gain a share since the entry price after h seconds.

    trades: keys, seq, ts (of entry), exit_ts, direction, entry_price, qty, net_pnl, fee. quotes: keys, ts, seq, mid. All times of a trade
    go through one as-of join; a mid older than the tolerance counts as none. Trades of sessions without quotes have
    none (unpriced tells which).
    """
    asked = {"exit": F.col("exit_ts"), "entry": F.col("ts")} | {f"mk_{h}": F.col("ts") + F.make_dt_interval(secs=F.lit(h)) for h in horizons_s}
    targets = trades.select(*keys, "seq", F.explode(F.array(*[F.struct(F.lit(name).alias("what"), at.alias("ts")) for name, at in asked.items()])).alias("_t")).select(*keys, "seq", "_t.*")
    found = asof(targets, quotes.select(*keys, "ts", "seq", "mid"), keys, tolerance_us=tolerance_s * 1_000_000)
    wide = found.groupBy(*keys, "seq").agg(*[F.max(F.when(F.col("what") == name, F.col("mid"))).alias(f"_{name}") for name in asked])
    out = trades.join(wide, [*keys, "seq"])
    marks = {f"mk_{h}": F.col("direction") * (F.col(f"_mk_{h}") - F.col("entry_price")) for h in horizons_s}
    return out.withColumns({"mid_entry": F.col("_entry"), "mid_exit": F.col("_exit"), **marks}).drop(*[f"_{name}" for name in asked])


def unpriced(trades: DataFrame, quotes: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """keys and the number of trades of sessions that have no quotes."""
    return trades.groupBy(*keys).agg(F.count("*").alias("trades")).join(quotes.select(*keys).distinct(), list(keys), "left_anti")


def at_mid() -> Column:
    """A trade's result if both legs were at the mid."""
    return F.col("direction") * (F.col("mid_exit") - F.col("mid_entry")) * F.col("qty") - F.col("fee")


def mark_totals(marked: DataFrame, *by: str, horizons_s: tuple[int, ...] = ()) -> DataFrame:
    """by, trades, sim_net, mid_to_mid, spread_capture, mid_win_rate and mk_<h>_rs (the mean markout of a whole trade).

    A trade without a mid adds nothing to mid_to_mid and counts as no win.
    """
    m = at_mid()
    out = marked.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.sum("net_pnl").alias("sim_net"),
        F.coalesce(F.sum(m), F.lit(0.0)).alias("mid_to_mid"),
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("mid_win_rate"),
        *[F.avg(F.col(f"mk_{h}") * F.col("qty")).alias(f"mk_{h}_rs") for h in horizons_s],
    )
    return out.withColumn("spread_capture", F.col("sim_net") - F.col("mid_to_mid"))


def net_of_retention(totals: DataFrame, steps: int = 20) -> DataFrame:
    """totals with a row for each share f of the spread that is kept: net = mid_to_mid + f * capture, and the share at which it is 0."""
    f = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps))
    out = totals.withColumn("break_even", F.try_divide(-F.col("mid_to_mid"), F.col("spread_capture"))).withColumn("f", f)
    return out.withColumn("net", F.col("mid_to_mid") + F.col("f") * F.col("spread_capture"))


def telemetry_totals(trades: DataFrame, now: Column, limit: float, by: str = "arm", tie: tuple[str, ...] = ()) -> DataFrame:
    """What a live snapshot at `now` tells of each arm.

    trades: by, entry_ts, exit_ts, gross_pnl, net_pnl. Trades entered later are not known yet; those that end later are open and count with
    their gross result so far. Columns: by, n_trades (closed), open_positions, realized, unrealized, total, day_net (closed on the day of now),
    halted (it has been at the loss limit or below during the day) and feed_age_s, the seconds since the last entry or exit.
    """
    known = trades.filter(F.col("entry_ts") <= now).withColumn("_open", F.col("exit_ts") > now)
    today = ~F.col("_open") & (F.to_date("exit_ts") == F.to_date(now))
    w = Window.partitionBy(by).orderBy("exit_ts", *tie).rowsBetween(Window.unboundedPreceding, 0)
    day = known.filter(today).withColumn("_run", F.sum("net_pnl").over(w)).groupBy(by).agg(F.sum("net_pnl").alias("day_net"), F.min("_run").alias("_least"))
    last = F.max(F.when(F.col("_open"), F.col("entry_ts")).otherwise(F.col("exit_ts")))
    out = known.groupBy(by).agg(
        F.count_if(~F.col("_open")).alias("n_trades"),
        F.count_if("_open").alias("open_positions"),
        F.sum(F.when(F.col("_open"), 0.0).otherwise(F.col("net_pnl"))).alias("realized"),
        F.sum(F.when(F.col("_open"), F.col("gross_pnl")).otherwise(0.0)).alias("unrealized"),
        last.alias("_last"),
    )
    out = out.join(day, by, "left").withColumns({"total": F.col("realized") + F.col("unrealized"), "day_net": F.coalesce("day_net", F.lit(0.0)), "halted": F.coalesce(F.col("_least") <= -limit, F.lit(False))})
    return out.withColumn("feed_age_s", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("_last").cast("timestamp"))).drop("_last", "_least")
