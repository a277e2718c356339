"""Sinks that may be written again: sessions by date and symbol, compaction, and logs by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .depth import LAYOUT, catalog
from .shared import move

ORDER = ("ts", "seq")


def write_sessions(df: DataFrame, root: str, keys: tuple[str, ...] = LAYOUT, order: tuple[str, ...] = ORDER) -> None:
    """Write root/<key>=.../*.parquet, sorted within files; a session that is written again is replaced whole.

    Sessions that df has no row of stay. Rows are dealt by the keys; adaptive execution joins small sessions
    in a task and splits large ones into several files. What a lost attempt has written is no part of root.
    """
    dealt = df.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def compact(spark: SparkSession, root: str, where: Column | None = None, order: tuple[str, ...] = ORDER, unique: tuple[str, ...] = ()) -> int:
    """Give each session (of those that `where`, over the layout's columns, picks) a sorted file compacted-*.parquet of its other files' rows.

    With `unique` rows that agree in these columns (and the session) are kept once. A session's file appears by one rename,
    so readers see it whole or not at all; they prefer it to the rest (recordings), and a compaction that ended early is
    run again. Sessions compacted before stay as they are. Returns how many were compacted.
    """
    files = catalog(spark, root).withColumn("done", F.max("compacted").over(_session()))
    open_ = files.filter(~F.col("done")).filter(where if where is not None else F.lit(True))
    paths = [r["path"] for r in open_.select("path").collect()]  # names of files
    if not paths:
        return 0
    rows = spark.read.option("basePath", root).parquet(*paths)
    if unique:
        rows = rows.dropDuplicates([*LAYOUT, *unique])
    part = f"{root.rstrip('/')}/_compacting-{uuid.uuid4().hex}"
    rows.repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, *order).write.partitionBy(*LAYOUT).parquet(part)
    made = [r["path"] for r in catalog(spark, part).select("path").collect()]
    for path in made:
        folder, name = path.rsplit("/", 1)
        move(spark, path, f"{folder.replace(part.rsplit('/', 1)[1] + '/', '', 1)}/compacted-{name}")
    return len(made)


def _session():
    from pyspark.sql import Window

    return Window.partitionBy(*LAYOUT)


def write_batch(df: DataFrame, batch_id: int, root: str, form: str = "parquet") -> None:
    """For foreachBatch: the rows of a batch as root/batch=<id>; a batch that comes again replaces its own rows."""
    df.write.mode("overwrite").format(form).option("header", True).save(f"{root.rstrip('/')}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: str, form: str = "parquet") -> DataFrame:
    """Rows of all batches, with their number as `batch`."""
    return spark.read.format(form).schema(f"{schema}, batch long").option("header", True).load(root)


def log_stream(df: DataFrame, root: str, checkpoint: str, form: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Append a stream to root batch by batch, each once however often it is tried; None takes what there is now and ends."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: write_batch(batch, i, root, form))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
