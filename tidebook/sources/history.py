"""History of bars from a service that answers a limited range a call, as a Python data source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


class Range(InputPartition):
    def __init__(self, symbol: str, first: date, last: date):
        self.symbol, self.first, self.last = symbol, first, last


def ranges(symbols: list[str], first: date, last: date, days: int) -> list[Range]:
    """Ranges of at most so many days, one partition each."""
    out = []
    for s in symbols:
        at = first
        while at <= last:
            end = min(last, at + timedelta(days=days - 1))
            out.append(Range(s, at, end))
            at = end + timedelta(days=1)
    return out


def retried(call: Callable[[], list], tries: int = 4, wait: float = 1.0, again: tuple = (429, 500, 502, 503, 504)) -> list:
    """call(), tried again after errors whose `status` may pass."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k + 1 == tries or getattr(e, "status", None) not in again:
                raise
            time.sleep(wait * 2**k)
    return []


def history_source(fetch: Callable[[str, date, date], list[tuple]], days: int, name: str = "bar_history", wait: float = 1.0) -> type[DataSource]:
    """A data source whose partitions call fetch(symbol, first, last) -> (ts, o, h, l, c, v) rows."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS

        def reader(self, schema) -> DataSourceReader:
            options = self.options

            class Reader(DataSourceReader):
                def partitions(self) -> list[InputPartition]:
                    return ranges(options["symbols"].split(","), date.fromisoformat(options["first"]), date.fromisoformat(options["last"]), days)

                def read(self, part: Range) -> Iterator[tuple]:
                    for row in retried(lambda: fetch(part.symbol, part.first, part.last), wait=wait):
                        yield (part.symbol, *row)

            return Reader()

    return Source


def bars(spark: SparkSession, name: str, symbols: list[str], first: str, last: str) -> DataFrame:
    """Bars of a registered source; of bars with one time the first by its prices stays."""
    df = spark.read.format(name).option("symbols", ",".join(symbols)).option("first", first).option("last", last).load()
    k = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("open", "high", "low", "close", "volume"))
    return df.withColumn("_k", k).filter("_k = 1").drop("_k")
