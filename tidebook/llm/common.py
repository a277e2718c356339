"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of `[\x20\x09-\x0D]`; what bytes.split() without arguments splits on.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset on a local master (tests) a folder of this machine is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(key: str, buckets: int) -> F.Column:
    """crc32 of a column written as text, modulo buckets; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def pieces(batches: Iterator[pa.RecordBatch], text: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `budget` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as str; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def n_windows(text: F.Column, chars: int) -> F.Column:
    """How many windows of `chars` characters a text has; an empty one has one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / chars)).cast("long")


def drawn_windows(docs: DataFrame, id_col: str, text: F.Column, chars: int, share: F.Column, bound: int, salt: int, *columns: F.Column) -> list:
    """Rows (*columns, part) of windows of `chars` characters, drawn by a hash from all windows of all whole texts.

    A window is drawn with probability `share`, and of those drawn the `bound` with the least draw
    against their share are returned: the bounded sample that a classifier learns from.
    """
    draw = lambda at: F.pmod(F.xxhash64(F.col(id_col), at, F.lit(salt)), F.lit(1_000_000_007)) / 1_000_000_007
    found = docs.filter(text.isNotNull()).select(F.col(id_col), text.alias("part"), share.alias("share"), *columns)
    names = found.columns[3:]
    found = found.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.length("part") - 1, F.lit(0)), F.lit(chars)), lambda x: draw(x) < F.col("share"))))
    found = found.select(*names, F.col("part").substr(F.col("at") + 1, F.lit(chars)).alias("part"), (draw(F.col("at")) / F.col("share")).alias("order"))
    return found.orderBy("order", "part").limit(bound).drop("order").collect()


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Inner join on `key`, which small holds once a value: each value's rows of big go to several tasks.

    small is repeated `salts` times, so it should be narrow.
    """
    salt = f"_salt_{uuid.uuid4().hex}"
    left = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, salt]).drop(salt)


def slices(data: bytes | str, separator: re.Pattern, size: int = 1 << 20) -> Iterator[bytes | str]:
    """A whole text in slices of about `size`, each cut at a separator, so that no word is torn."""
    start = 0
    while len(data) - start > size:
        found = separator.search(data, start + size)
        if not found:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:] if start else data


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
