"""As-of joins in both directions: against pandas, and in time on long sessions."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import joins as J

START = pd.Timestamp("2024-03-01 09:20")


def sides(spark, n, m, step_ms=400, seed=3):
    rng = np.random.default_rng(seed)
    make = lambda k, name: pd.DataFrame({"symbol": "A", "date": "d", "ts": START + pd.to_timedelta(np.sort(rng.integers(0, n * step_ms // 100, k)) * 100, "ms"), "seq": np.arange(k), name: rng.integers(0, 1000, k).astype(float)})
    left, right = make(n, "x"), make(m, "mid")
    return left, right, spark.createDataFrame(left), spark.createDataFrame(right)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 300])
def test_asof_equals_pandas(spark, direction, tolerance):
    left, right, a, b = sides(spark, 400, 150)
    right.loc[7, "mid"] = np.nan
    b = spark.createDataFrame(right).withColumn("mid", F.when(~F.isnan("mid"), F.col("mid")))
    keep = "last" if direction == "backward" else "first"
    want = pd.merge_asof(left, right.drop_duplicates("ts", keep=keep)[["ts", "mid"]], on="ts", direction=direction, tolerance=None if tolerance is None else pd.Timedelta(milliseconds=tolerance))
    got = J.asof(a, b, direction=direction, tolerance_us=None if tolerance is None else tolerance * 1000).orderBy("seq").toPandas()
    np.testing.assert_array_equal(got["mid"].to_numpy(float), want["mid"].to_numpy(float))


@pytest.mark.parametrize("tolerance", [None, 200])
def test_nearest_equals_search(spark, tolerance):
    left, right, a, b = sides(spark, 300, 90)
    at = right["ts"].to_numpy()
    want = []
    for t in left["ts"].to_numpy():
        gap = np.abs(at - t)
        close = np.flatnonzero(gap == gap.min())
        earlier = [k for k in close if at[k] <= t]
        k = earlier[-1] if earlier else close[0]
        want.append(right["mid"][k] if tolerance is None or gap.min() <= np.timedelta64(tolerance, "ms") else np.nan)
    got = J.nearest(a, b, tolerance_us=None if tolerance is None else tolerance * 1000).orderBy("seq").toPandas()
    np.testing.assert_array_equal(got["near"].to_numpy(float), np.array(want))


def test_nothing_on_one_side(spark):
    _, _, a, b = sides(spark, 5, 3)
    assert J.nearest(a, b.limit(0)).filter("near IS NULL").count() == 5
    assert J.asof(a, b.limit(0), direction="forward").filter("mid IS NULL").count() == 5
    assert J.nearest(a.limit(0), b).count() == 0


def test_forward_and_nearest_take_linear_time(spark):
    df = spark.range(100_000).select(F.lit("A").alias("symbol"), F.lit("d").alias("date"), F.timestamp_millis(F.lit(1_709_284_800_000) + F.col("id") * 400 + F.pmod(F.xxhash64("id"), F.lit(300))).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("mid"))
    left, right = df.filter("seq % 2 = 0").withColumnRenamed("mid", "x").persist(), df.filter("seq % 2 = 1").persist()
    left.count(), right.count()
    took = {}
    for name, made in (("warm", J.asof(left, right)), ("backward", J.asof(left, right)), ("forward", J.asof(left, right, direction="forward")), ("nearest", J.nearest(left, right))):
        began = time.perf_counter()
        made.write.format("noop").mode("overwrite").save()
        took[name] = time.perf_counter() - began
    left.unpersist(), right.unpersist()
    assert took["forward"] < 2 * took["backward"] + 1 and took["nearest"] < 3 * took["backward"] + 1, took
    plan = J.nearest(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
