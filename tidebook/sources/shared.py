"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    Only on a local master, where that is unset, is it a folder of this machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidebook-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file in one step, in place of what target may hold; both on the same file system, whichever it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    kind = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, how)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and rename it there, so that a reader sees the old text or the new one."""
    fs, part = _filesystem(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, part.toString(), path)


def text_of(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
