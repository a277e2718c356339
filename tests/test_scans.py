"""Chunked scans against the recurrences that go through a session in one piece; rank correlations against windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import evaluation as E
from tidebook.operators import recurrences as R
from tidebook.operators import scans as S


def series(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp("2024-03-01 09:00") + pd.to_timedelta(np.sort(rng.integers(0, 7200_000, n)), "ms")
    mid = 100 + rng.normal(0, 0.05, n).cumsum()
    x = [None if r < 0.3 or 60 < k < 140 or k < 5 else float(m) for k, (r, m) in enumerate(zip(rng.random(n), mid))]
    gap = [None, *np.diff(at).astype("timedelta64[ms]").astype(float) / 1000]
    rows = [("A" if k % 3 else "B", "d", t.to_pydatetime(), k, float(m), v, None if g is None else float(g) if k % 7 else 0.0) for k, (t, m, v, g) in enumerate(zip(at, mid, x, gap))]
    return spark.createDataFrame(rows, "symbol string, date string, ts timestamp_ntz, seq long, mid double, x double, gap double")


@pytest.mark.parametrize("minutes", [1, 17, 1000])
def test_ema_in_chunks(spark, minutes):
    df = series(spark)
    want = R.ema(df, "x", "y", alpha=0.1).orderBy("seq").toPandas()["y"]
    got = S.ema_scan(df, "x", "y", 0.1, minutes * 60_000_000).orderBy("seq").toPandas()
    np.testing.assert_allclose(got["y"].to_numpy(float), want.to_numpy(float), rtol=1e-10)
    assert got.columns.tolist() == [*df.columns, "y"]


@pytest.mark.parametrize("minutes", [1, 17, 1000])
@pytest.mark.parametrize("dt", [None, "gap"])
def test_kalman_in_chunks(spark, minutes, dt):
    df = series(spark)
    want = R.kalman(df, dt=dt).orderBy("seq").toPandas()
    got = S.kalman_scan(df, minutes * 60_000_000, dt=dt).orderBy("seq").toPandas()
    for c in ("kf_level", "kf_velocity"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-8, atol=1e-10)


def test_elements_of_long_chunks_stay_exact():
    rng = np.random.default_rng(1)
    z, t = 100 + rng.normal(0, 0.05, 60_000).cumsum(), rng.exponential(0.4, 60_000) + 1e-3
    level, speed = R.kalman_levels(z, t, 1e-6, 1e-2, 1.0)
    a, b, c, eta, j = S._together(S._element(z[1:], t[1:], 1e-6, 1e-2))
    x = a @ np.linalg.inv(np.eye(2) + np.eye(2) @ j) @ (np.array([z[0], 0.0]) + eta) + b
    np.testing.assert_allclose(x, [level[-1], speed[-1]], rtol=1e-7)


def test_a_session_is_spread_over_tasks(spark):
    df = series(spark).filter("symbol = 'A'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = S.ema_scan(df, "x", "y", 0.1, 60_000_000).withColumn("task", F.spark_partition_id())
        assert out.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = S.ema_scan(df, "x", "y", 0.1, 60_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_rank_correlations_equal_windows(spark):
    df = series(spark).withColumns({"s1": F.round("mid", 1), "s2": F.col("x"), "s3": F.lit(1.0), "fwd_1": F.when(F.col("seq") < 390, F.round(F.sin("seq"), 1)), "fwd_2": F.when(F.col("seq") % 5 > 0, F.col("mid"))})
    args = (("s1", "s2", "s3"), (1, 2))
    order = ["symbol", "signal", "horizon"]
    a, b = (f(df, *args, least=20).orderBy(*order).toPandas() for f in (E.signal_ic, E.signal_ic_windows))
    assert a[[*order, "n"]].equals(b[[*order, "n"]]) and len(a) == 12
    np.testing.assert_allclose(a["ic"].to_numpy(float), b["ic"].to_numpy(float), rtol=1e-12)
    assert a[a.signal == "s3"]["ic"].isna().all()
    assert E.signal_ic(df.limit(0), *args).count() == 0
    assert E.signal_ic(df, *args, least=1000).filter("ic IS NOT NULL").count() == 0


def test_hurst_takes_every_scale(spark):
    from tidebook.operators import regime as G

    rng = np.random.default_rng(8)
    n = 100_000
    x = np.log(100) + rng.normal(0, 1e-4, n).cumsum()
    scales, points = [], []
    w = 8
    while w <= n // 2:
        ratios = []
        for s in range(0, n - w + 1, w):
            part = x[s : s + w]
            walk = np.cumsum(part - part.mean())
            if part.std() > 0:
                ratios.append((walk.max() - walk.min()) / part.std())
        scales.append(np.log(w))
        points.append(np.log(np.mean(ratios)))
        w *= 2
    assert len(scales) == 13
    want = np.polyfit(scales, points, 1)[0]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(n), "mid": np.exp(x)}).sample(frac=1, random_state=1))
    assert abs(G.hurst(df, ("k",)).first()["hurst"] - want) < 1e-9
    short = df.filter("i < 15")
    assert G.hurst(short, ("k",)).first()["hurst"] is None
    assert G.hurst(df.limit(0), ("k",)).count() == 0


def test_percentiles_of_a_narrow_key_are_exact_and_sort_little(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "ties").otherwise("narrow").alias("k"), F.when(F.col("id") % 10 == 0, F.floor(F.col("id") / 50_000).cast("double")).otherwise(1000 + F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 1e6).alias("v"))
    local = df.toPandas()
    shares = {"low": 0.0, "p1": 0.01, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r["k"]: r for r in E.percentiles(df, ("k",), "v", shares).collect()}
    for k, part in local.groupby("k"):
        want = np.percentile(part["v"], [100 * q for q in shares.values()])
        np.testing.assert_allclose([got[k][c] for c in shares], want, rtol=1e-14)
    counted = E.percentiles(df, ("k",), "v", {"mid": 0.5})._jdf.queryExecution()
    assert "Window" in counted.executedPlan().toString()
    ranks = E.at_ranks(df.withColumn("one", F.lit(1)), ("one",), "v", {"x": (0.6, lambda t: F.floor(t * 0.6) - 1)}).first()
    assert ranks["x"] == np.sort(local["v"])[int(n * 0.6) - 1] and ranks["total"] == n
