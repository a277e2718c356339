"""As-of joins: both sides in one window, the right side's last row carried to the left's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _struct(df: DataFrame, packed: Column):
    return df.select(packed.alias("x")).schema["x"].dataType


def _carried(left: DataFrame, right: DataFrame, keys: tuple[str, ...], on: str, tie: str, packed: Column, directions: dict[str, str]) -> DataFrame:
    """keys, on, tie, _left and, by name, the right row found in each direction: 'backward' or 'forward'.

    Both sides are dealt by the keys together, once for all directions. Forward is backward in the reversed order, so
    a row looks at what is carried to it, never at the rest of its session.
    """
    whole = F.struct(*left.columns)
    plain = left.select(*keys, on, tie, whole.alias("_left"), F.lit(None).cast(_struct(right, packed)).alias("_right"), F.lit(1).alias("_side"))
    donors = right.select(*keys, on, tie, F.lit(None).cast(_struct(left, whole)).alias("_left"), packed.alias("_right"), F.lit(0).alias("_side"))
    order = {"backward": (F.asc(on), F.asc("_side"), F.asc(tie)), "forward": (F.desc(on), F.asc("_side"), F.desc(tie))}
    every = plain.unionByName(donors)
    for name, direction in directions.items():
        carried = Window.partitionBy(*keys).orderBy(*order[direction]).rowsBetween(Window.unboundedPreceding, 0)
        every = every.withColumn(name, F.last("_right", ignorenulls=True).over(carried))
    return every.filter(F.col("_left").isNotNull())


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, ...] = ("symbol", "date"),
    on: str = "ts",
    tie: str = "seq",
    tolerance_us: int | None = None,
    direction: str = "backward",
    source: str | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """Each left row with the last right row of its keys at or before it (forward: the first at or after).

    Left rows stay, with nulls where there is none or it is further than the tolerance. Of right
    rows at one time the last by `tie` counts (forward: the first). A row is taken whole: null
    values in it aren't skipped. Right columns named as a left column get the suffix; `source`
    names a column for the right row's time. Rows are dealt by the keys and sorted once.
    """
    other = [c for c in right.columns if c not in (*keys, on, tie)]
    names = {c: c if c not in left.columns else c + suffix for c in other}
    packed = F.struct(F.col(on).alias("_at"), *[F.col(c).alias(names[c]) for c in other])
    every = _carried(left, right, keys, on, tie, packed, {"_found": direction})
    near = F.col("_found")
    if tolerance_us is not None:
        near = F.when(F.abs(_micros(on) - _micros(F.col("_found._at"))) <= tolerance_us, near)
    return every.withColumn("_found", near).select("_left.*", *[F.col(f"_found.{names[c]}").alias(names[c]) for c in other], *([F.col("_found._at").alias(source)] if source else []))


def nearest(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), on: str = "ts", tie: str = "seq", value: str = "mid", name: str = "near", tolerance_us: int | None = None
) -> DataFrame:
    """Each left row with `value` of the right row closest in time; the earlier of two equally close.

    Null where there is none, or none within the tolerance. One exchange serves both directions.
    """
    packed = F.struct(F.col(on).alias("_at"), F.col(value).alias("_v"))
    every = _carried(left, right, keys, on, tie, packed, {"_b": "backward", "_f": "forward"})
    before, after = _micros(on) - _micros(F.col("_b._at")), _micros(F.col("_f._at")) - _micros(on)
    found = F.when(after.isNull() | (before <= after), F.col("_b._v")).otherwise(F.col("_f._v"))
    if tolerance_us is not None:
        found = F.when(F.least(before, after) <= tolerance_us, found)
    return every.select("_left.*", found.alias(name))


def markout(fills: DataFrame, quotes: DataFrame, horizons_s: tuple[int, ...], tolerance_s: int, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """A row per fill and horizon with the mid then, and the gain a share since the fill price.

    fills: keys, ts, seq, direction, price. All horizons go through one as-of join; a quote older
    than the tolerance counts as none.
    """
    targets = fills.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons_s])))
    targets = targets.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("horizon")))
    found = asof(targets, quotes.select(*keys, "ts", "seq", "mid"), keys, tolerance_us=tolerance_s * 1_000_000)
    return found.withColumn("markout", F.col("direction") * (F.col("mid") - F.col("price")))


def pair_sides(messages: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Pairs of the latest bid and ask message of a key; emitting a pair consumes both.

    messages: keys, ts, seq, side ('bid' or 'ask'). Returns keys, bid_seq, ask_seq, one row where
    the second of a pair arrives. What a key holds is one message a side.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "bid_seq long, ask_seq long"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for seq, side in rows.sort_values(["ts", "seq"])[["seq", "side"]].itertuples(index=False):
            held[side] = seq
            if len(held) == 2:
                out.append((*key, held["bid"], held["ask"]))
                held = {}
        return pd.DataFrame(out, columns=[*keys, "bid_seq", "ask_seq"])

    return messages.select(*keys, "ts", "seq", "side").groupBy(*keys).applyInPandas(run, schema)


def unmatched(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Groups of left without any right row, with their numbers of rows."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).count()
