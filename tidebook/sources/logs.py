"""Trade logs, snapshots and instrument masters."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import replace_text, text_of

TRADE_LOG = (
    "underlying string, date string, direction string, entry_ts string, exit_ts string, entry_price string, exit_price string, entry_method string, exit_method string, lot_size string,"
    " n_lots string, notional string, hold_packets string, hold_secs string, gross_pnl string, fee string, net_pnl string, queue_ahead string, qty_consumed string"
)
NUMBERS = ("entry_price", "exit_price", "notional", "hold_secs", "gross_pnl", "fee", "net_pnl")


def trade_logs(spark: SparkSession, root: str, days: list[str] | None = None, name: str = "paper_trades.csv") -> DataFrame:
    """Rows of root/<arm>/<name>, with `arm` from the path; numbers that can't be read are 0.0.

    Fields are text, so a damaged one spoils no other; an empty queue field is null.
    """
    df = spark.read.schema(TRADE_LOG).option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").csv(f"{root}/*/{name}")
    df = df.withColumn("arm", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    df = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in NUMBERS})
    df = df.withColumns({c: F.col(c).try_cast("double") for c in ("queue_ahead", "qty_consumed")})
    return df.filter(F.col("date").isin(days)) if days else df


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """security_id, symbol, exchange, segment, instrument, expiry and lot; rows that can't be read go."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    has = lambda c: F.upper(F.trim(F.col(c)))
    out = raw.select(
        F.col("SECURITY_ID").try_cast("long").alias("security_id"),
        has("UNDERLYING_SYMBOL").alias("symbol"),
        has("EXCH_ID").alias("exchange"),
        has("SEGMENT").alias("segment"),
        has("INSTRUMENT").alias("instrument"),
        F.try_to_date(F.substring("SM_EXPIRY_DATE", 1, 10)).alias("expiry"),
        F.col("LOT_SIZE").try_cast("double").cast("int").alias("lot"),
    )
    return out.filter("security_id IS NOT NULL AND expiry IS NOT NULL AND lot IS NOT NULL AND symbol <> ''")


def front_month(df: DataFrame, as_of, keys: tuple[str, ...] = ("symbol",), expiry: str = "expiry", tie: str = "security_id", wanted: DataFrame | None = None) -> DataFrame:
    """Of each symbol the contract that expires first on or after `as_of`; equal ones by id.

    With `wanted`(keys), exactly those symbols are told, and one without such a contract is an error when it is read.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(expiry, tie))
    found = df.filter(F.col(expiry) >= F.lit(as_of)).withColumn("_k", first).filter("_k = 1").drop("_k")
    if wanted is None:
        return found
    asked = wanted.select(*keys).distinct().join(found.withColumn("_there", F.lit(True)), list(keys), "left")
    said = F.concat(F.lit("no contract of "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]), F.lit(f" expires on or after {as_of}"))
    return asked.filter(F.when(F.col("_there").isNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).select(found.columns)


def unresolved(wanted: DataFrame, found: DataFrame, key: str = "symbol") -> DataFrame:
    return wanted.select(key).distinct().join(found, key, "left_anti")


def write_snapshot(row: dict, path: str) -> None:
    """Replace a small JSON file in one step, on whichever file system path names, so that a reader never sees half of it."""
    replace_text(SparkSession.active(), path, json.dumps(row))


def read_snapshot(path: str) -> dict | None:
    """The snapshot, or None where it is missing or damaged."""
    try:
        return json.loads(text_of(SparkSession.active(), path) or "")
    except (ValueError, Py4JJavaError):
        return None
