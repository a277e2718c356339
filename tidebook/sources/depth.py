"""Scans of depth recordings, laid out by date and symbol, and what makes sessions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, SHUT = "09:20", "15:25"
LEVELS = 20


LAYOUT = ("trading_date", "symbol")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """A row per file of root/trading_date=D/symbol=S/*.parquet: the layout's columns, path, length, modified, compacted.

    It comes from the file listing alone; no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("basePath", root).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(*LAYOUT, "path", "length", F.col("modificationTime").alias("modified"), name.startswith("compacted").alias("compacted"))


def recordings(spark: SparkSession, root: str, symbols: list[str] | None = None, dates: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """Rows of root/trading_date=D/symbol=S/*.parquet with `underlying` taken from the symbol.

    Files are chosen before any is read: those of the dates and underlyings asked for, and where a symbol's day has
    compacted files only those. The names of the chosen files are what the plan's scan lists, as any scan's file index
    does. With `tolerant`, files that are damaged or vanish are left out, a damaged compacted file as if it weren't there
    (the footers of compacted files are looked at for this); else they are an error.
    """
    underlying = F.split("symbol", "-")[0]

    def wanted(df: DataFrame) -> DataFrame:
        if dates:
            df = df.filter(F.col("trading_date").cast("string").isin(dates))
        return df.filter(underlying.isin(symbols)) if symbols else df

    listed = wanted(catalog(spark, root))
    files = [(r["trading_date"], r["symbol"], r["path"], r["compacted"]) for r in listed.collect()]  # names of files
    if tolerant and any(f[3] for f in files):
        opened = spark.read.options(basePath=root, ignoreCorruptFiles=True, ignoreMissingFiles=True).schema(listed.select(*LAYOUT).schema)
        whole = opened.parquet(*[f[2] for f in files if f[3]]).select(F.col("_metadata.file_name").alias("name"), *LAYOUT).distinct().collect()
        whole = {(r["trading_date"], r["symbol"], r["name"]) for r in whole}
        files = [f for f in files if not f[3] or (f[0], f[1], f[2].rsplit("/", 1)[1]) in whole]
    done = {f[:2] for f in files if f[3]}
    paths = [f[2] for f in files if f[3] or f[:2] not in done]
    reader = spark.read.options(**{"basePath": root, "mergeSchema": "false", "ignoreCorruptFiles": tolerant, "ignoreMissingFiles": tolerant})
    df = reader.parquet(*paths) if paths else reader.parquet(root).limit(0)
    return wanted(df).withColumn("underlying", underlying)


def one_contract(df: DataFrame) -> DataFrame:
    """Fails where an underlying's day has several contracts; else df as it is."""
    n = F.size(F.collect_set("symbol").over(Window.partitionBy("underlying", "trading_date")))
    said = F.concat(F.lit("several contracts of "), "underlying", F.lit(" on "), F.col("trading_date").cast("string"))
    return df.withColumn("_ok", F.when(n > 1, F.raise_error(said)).otherwise(F.lit(True))).filter("_ok").drop("_ok")


def levels(df: DataFrame) -> DataFrame:
    """The 120 wide level columns as six arrays."""
    names = [f"{s}_{k}" for s in ("bid", "ask") for k in ("price", "qty", "orders")]
    arrays = {n: F.array(*[F.col(f"{n}_{i:02d}") for i in range(1, LEVELS + 1)]) for n in names}
    return df.withColumns(arrays).drop(*[f"{n}_{i:02d}" for n in names for i in range(1, LEVELS + 1)])


def local_time(ts: str | Column, minutes: int = 330) -> Column:
    """UTC moved to the exchange's clock, without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes))


def in_session(ts: str = "ts", start: str = OPEN, end: str = SHUT) -> Column:
    """Both ends included."""
    day = F.to_date(ts)
    return (F.col(ts) >= day + F.expr(f"INTERVAL '{start}' HOUR TO MINUTE")) & (F.col(ts) <= day + F.expr(f"INTERVAL '{end}' HOUR TO MINUTE"))


def sessions(df: DataFrame, least: int = 50_000, keys: tuple[str, ...] = ("symbol", "date"), filtered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of sessions that are long enough, skipped sessions with their number of rows).

    With `filtered` only rows within trading hours count, and only then is the length asked for.
    """
    if not filtered:
        return df, df.limit(0).select(*keys).withColumn("n", F.lit(0).cast("long"))
    inside = df.filter(in_session())
    n = F.count("*").over(Window.partitionBy(*keys))
    kept = inside.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")
    skipped = df.groupBy(*keys).agg(F.count_if(in_session()).alias("n")).filter(F.col("n") < least)
    return kept, skipped


def first_level(df: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Good quotes with mid, micro-price deviation and seconds since the last row (0 first, never negative)."""
    good = df.filter((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")))
    total = (F.col("bid_qty") + F.col("ask_qty")).cast("double")
    mid = (F.col("bid") + F.col("ask")) / 2
    micro = F.when(total > 0, (F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty")) / total).otherwise(mid)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (us - F.lag(us).over(Window.partitionBy(*keys).orderBy("ts", "seq"))) / 1e6
    return good.withColumns({"mid": mid, "microprice": micro, "micro_dev": micro - mid, "dt": F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0))})


def calibration(df: DataFrame, size: str = "bid_qty", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, date and `calib`: the median size of the last day before that has rows, null on the first.

    The median is of the whole day, not of trading hours.
    """
    daily = df.groupBy(*keys, "date").agg(F.median(size).alias("_m"))
    return daily.select(*keys, "date", F.lag("_m").over(Window.partitionBy(*keys).orderBy("date")).alias("calib"))
