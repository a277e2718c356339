"""Market views of the driver's tables, as DataFrames and as the same CTEs for DuckDB.

Five event types are five symbols, embeddings are twenty-level books, and order lines are trades
of five strategies. Sessions are (symbol, date); every view carries the total order (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

LEVELS = 20
TICK = 0.05


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, date, k, user_id, mid."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("date"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
        F.col("value").alias("mid"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks with a first level: bid, ask, bid_qty, ask_qty. Some bids are zero or negative."""
    half = F.lit(0.05) * (1 + F.col("k") % 5)
    return ticks(spark, sf_dir).select(
        "symbol",
        "ts",
        "seq",
        "date",
        "k",
        F.when(F.col("seq") % 97 == 0, 0.0).otherwise(F.col("mid") - half).alias("bid"),
        (F.col("mid") + half).alias("ask"),
        (100 * (1 + F.col("user_id") % 17)).alias("bid_qty"),
        (100 * (1 + F.col("k") % 13)).alias("ask_qty"),
    )


def clean(df: DataFrame) -> DataFrame:
    """Without zero, negative or crossed quotes."""
    return df.filter((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty levels a side as arrays: {bid,ask}_{price,qty,orders}."""
    e = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: F.abs(x.cast("double")))
    qty = lambda a: F.transform(e(a, LEVELS), lambda x: (1 + F.floor(1000 * x)).cast("long"))
    orders = F.transform(e(41, LEVELS), lambda x: (1 + F.floor(20 * x)).cast("long"))
    centre = F.lit(100.0) + F.lit(TICK) * (F.col("vec_id") % 3)
    price = lambda side: F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: centre + side * TICK * i)
    ts = F.timestamp_millis(F.lit(1_717_400_000_000) + F.col("vec_id") * 400).cast("timestamp_ntz")
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("S"), (F.col("label") % 2).cast("string")).alias("symbol"),
        ts.alias("ts"),
        F.col("vec_id").alias("seq"),
        F.to_date(ts).alias("date"),
        price(-1).alias("bid_price"),
        price(1).alias("ask_price"),
        qty(1).alias("bid_qty"),
        qty(21).alias("ask_qty"),
        orders.alias("bid_orders"),
        F.reverse(orders).alias("ask_orders"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of five arms (order priorities): prices, fees, gross and net."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    side = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    # Money in whole cents, so that both engines add the same numbers.
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    edge = F.round(F.col("l_discount") * 100).cast("long") - 5
    gross = side * F.signum(edge).cast("long") * F.floor(cents * F.abs(edge) / 100)
    fee = F.floor(cents * F.round(F.col("l_tax") * 100).cast("long") / 1000)
    return joined.select(
        F.col("o_orderpriority").alias("arm"),
        F.col("l_returnflag").alias("underlying"),
        side.alias("direction"),
        F.least("o_orderdate", "l_shipdate").alias("entry_ts"),
        F.greatest("o_orderdate", "l_shipdate").alias("exit_ts"),
        F.to_date(F.greatest("o_orderdate", "l_shipdate")).alias("date"),
        F.when(F.col("l_linenumber") % 3 == 0, "taker_stop").when(F.col("l_linenumber") % 3 == 1, "maker_exit").otherwise("taker_max_hold").alias("exit_method"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (gross / 100).alias("gross_pnl"),
        (fee / 100).alias("fee"),
        ((gross - fee) / 100).alias("net_pnl"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, day (month of exit), pnl."""
    t = trades(spark, sf_dir)
    return t.groupBy("arm", F.date_format("date", "yyyy-MM").alias("day")).agg(F.round(F.sum("net_pnl"), 2).alias("pnl"))


def kept_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily with the numbers of trades and of wins, written to the shared folder: a row an arm and month.

    For plans that read it several times, each of which would join the trades once more.
    """
    t = trades(spark, sf_dir)
    day = t.groupBy("arm", F.date_format("date", "yyyy-MM").alias("day")).agg(F.round(F.sum("net_pnl"), 2).alias("pnl"), F.count("*").alias("trades"), F.count_if(F.col("net_pnl") > 0).alias("wins"))
    path = shared_folder(spark, "daily")
    day.write.parquet(path)
    return spark.read.schema(day.schema).parquet(path)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, hour, close: the last clean mid of each hour; empty hours are left out."""
    t = ticks(spark, sf_dir).filter("mid > 0")
    return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("mid", F.struct("ts", "seq")).alias("close"))


SQL = {
    "ticks": """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, CAST(ts AS DATE) AS date,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, value AS mid FROM events)""",
    "quotes": """quotes AS (SELECT symbol, ts, seq, date, k,
        CASE WHEN seq % 97 = 0 THEN 0.0::DOUBLE ELSE mid - 0.05::DOUBLE * (1 + k % 5) END AS bid,
        mid + 0.05::DOUBLE * (1 + k % 5) AS ask, 100 * (1 + user_id % 17) AS bid_qty, 100 * (1 + k % 13) AS ask_qty FROM ticks)""",
    "clean": "clean AS (SELECT * FROM quotes WHERE bid > 0 AND ask > 0 AND ask >= bid)",
    "book": """book AS (SELECT 'S' || (label % 2)::VARCHAR AS symbol,
        make_timestamp((1717400000000 + vec_id * 400) * 1000) AS ts, vec_id AS seq,
        CAST(make_timestamp((1717400000000 + vec_id * 400) * 1000) AS DATE) AS date,
        list_transform(range(1, 21), lambda i: 100.0::DOUBLE + 0.05::DOUBLE * (vec_id % 3) - 0.05::DOUBLE * i) AS bid_price,
        list_transform(range(1, 21), lambda i: 100.0::DOUBLE + 0.05::DOUBLE * (vec_id % 3) + 0.05::DOUBLE * i) AS ask_price,
        list_transform(embedding[1:20], lambda x: (1 + floor(1000 * abs(x::DOUBLE)))::BIGINT) AS bid_qty,
        list_transform(embedding[21:40], lambda x: (1 + floor(1000 * abs(x::DOUBLE)))::BIGINT) AS ask_qty,
        list_transform(embedding[41:60], lambda x: (1 + floor(20 * abs(x::DOUBLE)))::BIGINT) AS bid_orders,
        list_reverse(list_transform(embedding[41:60], lambda x: (1 + floor(20 * abs(x::DOUBLE)))::BIGINT)) AS ask_orders FROM embeddings)""",
    "trades": """trades AS (SELECT * EXCLUDE (gross, fees), gross / 100 AS gross_pnl, fees / 100 AS fee, (gross - fees) / 100 AS net_pnl FROM (
        SELECT o_orderpriority AS arm, l_returnflag AS underlying,
        CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction,
        least(o_orderdate, l_shipdate) AS entry_ts, greatest(o_orderdate, l_shipdate) AS exit_ts,
        CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS date,
        CASE l_linenumber % 3 WHEN 0 THEN 'taker_stop' WHEN 1 THEN 'maker_exit' ELSE 'taker_max_hold' END AS exit_method,
        l_quantity AS qty, l_extendedprice / l_quantity AS price,
        (CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) * sign(round(l_discount * 100)::BIGINT - 5)::BIGINT
            * floor(round(l_extendedprice * 100)::BIGINT * abs(round(l_discount * 100)::BIGINT - 5) / 100)::BIGINT AS gross,
        floor(round(l_extendedprice * 100)::BIGINT * round(l_tax * 100)::BIGINT / 1000)::BIGINT AS fees,
        l_orderkey AS order_key, l_linenumber::BIGINT AS line,
        l_partkey AS part_key, l_suppkey AS supp_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "daily": "daily AS (SELECT arm, strftime(date, '%Y-%m') AS day, round(sum(net_pnl), 2) AS pnl FROM trades GROUP BY ALL)",
    "bars": """bars AS (SELECT symbol, date_trunc('hour', ts) AS hour, arg_max(mid, (ts, seq)) AS close FROM ticks WHERE mid > 0 GROUP BY ALL)""",
}
_NEEDS = {"quotes": "ticks", "clean": "quotes", "daily": "trades", "bars": "ticks"}


def with_views(*names: str) -> str:
    """A WITH prefix that defines these views and what they need; further CTEs may follow after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order)
