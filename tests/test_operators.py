"""Operators on small cases worked out by hand, and against packet-by-packet loops."""

import math
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.operators import evaluation as E
from tidebook.operators import joins as J
from tidebook.operators import recurrences as R
from tidebook.operators import regime as G
from tidebook.operators import simulators as S
from tidebook.sources import depth, history, logs, packets
from tidebook.streaming import live

T0 = datetime(2026, 6, 1, 4, 0)


def at(s):
    return T0 + timedelta(seconds=s)


# Functions


@pytest.mark.parametrize("z", [0.0, 1.0, -2.5, 4.0, -6.0, 2.999, 3.001, -0.3, 7.5])
def test_normal_cdf_and_inverse(spark, z):
    p = math.erfc(-z / math.sqrt(2)) / 2
    r = spark.range(1).select(C.normal_cdf(F.lit(z)).alias("p"), C.normal_ppf(F.lit(p)).alias("z")).first()
    assert r["p"] == pytest.approx(p, rel=1e-9)
    if z < 7:  # beyond, p is 1 but for its last digits
        assert r["z"] == pytest.approx(z, abs=1e-6)


def test_fee_of_a_round_trip(spark):
    buy, sell = 100.0 * 550, 101.0 * 550
    want = 40 + 0.000021 * (buy + sell) + 0.000125 * sell + 0.00002 * buy + 0.18 * (40 + 0.000021 * (buy + sell))
    assert S.charges(100, 101, 550, 1) == pytest.approx(want)
    r = spark.range(1).select(C.round_trip_fee(F.lit(100.0), F.lit(101.0), F.lit(550), F.lit(1)).alias("a"), C.round_trip_fee(F.lit(101.0), F.lit(100.0), F.lit(550), F.lit(-1)).alias("b")).first()
    assert r["a"] == pytest.approx(want) and r["b"] == pytest.approx(want)


# As-of


def test_asof_ties_tolerance_and_null_values(spark):
    left = spark.createDataFrame([("A", at(s), s, s) for s in (0, 5, 10, 30)], "k string, ts timestamp, seq long, x int")
    right = spark.createDataFrame([("A", at(5), 1, 1.0), ("A", at(5), 2, 2.0), ("A", at(9), 3, None), ("B", at(0), 4, 9.0)], "k string, ts timestamp, seq long, v double")
    out = {r["x"]: r["v"] for r in J.asof(left, right, keys=("k",)).collect()}
    assert out == {0: None, 5: 2.0, 10: None, 30: None}  # the last row is taken, though its value is null
    near = {r["x"]: r["at"] for r in J.asof(left, right, keys=("k",), tolerance_us=5_000_000, source="at").collect()}
    assert near[10] == at(9) and near[30] is None
    ahead = {r["x"]: r["v"] for r in J.asof(left, right, keys=("k",), direction="forward").collect()}
    assert ahead == {0: 1.0, 5: 1.0, 10: None, 30: None}


def test_asof_against_pandas(spark):
    rng = random.Random(1)
    l = pd.DataFrame({"k": "A", "ts": sorted(at(rng.randrange(500)) for _ in range(80)), "seq": range(80)})  # noqa: E741
    r = pd.DataFrame({"k": "A", "ts": sorted(at(rng.randrange(500)) for _ in range(60)), "seq": range(60), "v": [float(i) for i in range(60)]})
    want = pd.merge_asof(l, r[["ts", "v"]], on="ts", tolerance=pd.Timedelta("20s"))["v"]
    got = J.asof(spark.createDataFrame(l), spark.createDataFrame(r), keys=("k",), tolerance_us=20_000_000).orderBy("seq").toPandas()["v"]
    assert np.array_equal(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


# Recurrences and regimes


def test_ema_decays_over_gaps(spark):
    x = [None, None, 1.0, 2.0, None, 4.0]
    df = spark.createDataFrame([("A", "d", at(i), i, v) for i, v in enumerate(x)], "symbol string, date string, ts timestamp, seq long, x double")
    got = [r["y"] for r in R.ema(df, "x", "y", alpha=0.5).orderBy("seq").collect()]
    assert got[:2] == [None, None] or all(v is None or math.isnan(v) for v in got[:2])
    assert got[2:] == pytest.approx([1, 1.5, 1.5, 3.1666667])


def test_kalman_follows_a_ramp():
    z = np.arange(400) * 0.1
    level, speed = R.kalman_levels(z, np.ones(400), 1e-6, 1e-2, 1.0)
    assert level[0] == 0 and speed[0] == 0
    assert speed[-1] == pytest.approx(0.1, abs=0.01) and level[-1] == pytest.approx(z[-1], abs=0.05)


def test_variance_ratio_tells_trend_from_reversal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, phi in (("up", 0.5), ("none", 0.0), ("down", -0.5)):
        r = np.zeros(4000)
        for i in range(1, 4000):
            r[i] = phi * r[i - 1] + rng.normal() * 1e-4
        rows += [(name, i, float(p)) for i, p in enumerate(100 * np.exp(np.cumsum(r)))]
    vr = {r["k"]: r["vr"] for r in G.variance_ratio(spark.createDataFrame(rows, "k string, i int, mid double"), ("k",), 10).collect()}
    assert vr["up"] > 1.5 and 0.8 < vr["none"] < 1.2 and vr["down"] < 0.7


def test_unit_root_p_values(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=500)
    rows = [("walk", i, float(x)) for i, x in enumerate(np.cumsum(noise))] + [("noise", i, float(x)) for i, x in enumerate(noise)]
    p = {r["k"]: r["adf_p"] for r in G.dickey_fuller(spark.createDataFrame(rows, "k string, i int, s double"), ("k",), "i").collect()}
    assert p["noise"] < 1e-6 and p["walk"] > 0.05
    # Published 5 % and 1 % points of the statistic.
    five, one = (spark.range(1).select(G.unit_root_p(F.lit(t)).alias("p")).first()["p"] for t in (-2.86, -3.43))
    assert five == pytest.approx(0.05, abs=0.003) and one == pytest.approx(0.01, abs=0.002)


def test_ou_fit_recovers_the_process(spark):
    rng = np.random.default_rng(5)
    s = [0.0]
    for _ in range(8000):
        s.append(0.2 + 0.9 * s[-1] + rng.normal() * 0.1)
    r = G.ou_fit(spark.createDataFrame([("p", i, float(x)) for i, x in enumerate(s)], "k string, i int, s double"), ("k",), "i").first()
    assert r["b"] == pytest.approx(0.9, abs=0.02) and r["mu"] == pytest.approx(2.0, abs=0.1) and r["half_life"] == pytest.approx(math.log(2) / -math.log(0.9), rel=0.2)


# Statistics


def matrix(spark, shift, arms, days=12, seed=7):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"a{a}", f"d{d:02d}", float(rng.normal() + (shift if a == 0 else 0))) for a in range(arms) for d in range(days)], "arm string, day string, pnl double")


def test_pbo_is_low_for_skill_and_high_for_noise(spark):
    assert E.pbo(matrix(spark, 5.0, 4)).first()["pbo"] < 0.1
    noisy = [E.pbo(matrix(spark, 0.0, 6, seed=s)).first() for s in (1, 2, 3)]
    assert sum(r["pbo"] for r in noisy) / 3 > 0.3 and noisy[0]["n_splits"] == 20


def test_deflation_lowers_confidence(spark):
    for r in E.deflated(matrix(spark, 0.8, 7)).collect():
        assert r["dsr"] is None or r["dsr"] <= r["psr"] + 1e-12


def test_paired_bootstrap(spark):
    df = spark.createDataFrame([("x", f"d{i}", 3.0 + 0.01 * (i % 2)) for i in range(5)], "arm string, day string, diff double")
    r = E.bootstrap(df, ("arm",), "diff", "day", draws=200).first()
    assert r["n"] == 5 and r["mean"] == pytest.approx(3.004) and r["p_gt0"] == 1.0 and 3.0 <= r["low"] <= r["high"] <= 3.01


def test_effective_size_falls_with_correlation(spark):
    rng = np.random.default_rng(6)
    x = [0.0]
    for _ in range(799):
        x.append(0.6 * x[-1] + rng.normal())
    rows = [("ar", i, float(v)) for i, v in enumerate(x)] + [("iid", i, float(v)) for i, v in enumerate(rng.normal(size=800))]
    n = {r["k"]: r["n_eff"] for r in E.effective_size(spark.createDataFrame(rows, "k string, i int, v double"), "v", ("k",), ("i",)).collect()}
    assert n["ar"] < 400 < n["iid"] <= 800


# Simulators


def taker_loop(mid, sig, p):
    """The rules, packet by packet."""
    out, pos, last, prev = [], None, -(p.cooldown + 1), 0.0
    for i, (m, s) in enumerate(zip(mid, sig)):
        if math.isnan(m) or math.isnan(s):
            prev = 0.0
            continue
        if pos is None:
            if i - last > p.cooldown and abs(s) >= p.threshold and (not p.fresh_cross or prev < p.threshold):
                d = 1 if s > 0 else -1
                pos = (i, d, m + d * p.slip_ticks * S.TICK)
        else:
            j, d, entry = pos
            why = "max_hold" if i - j >= p.max_hold else "stop" if d * (m - entry) < -p.stop_ticks * S.TICK else None
            if why is None and p.reversal is not None and i - j >= p.min_hold and d * s < -p.reversal:
                why = "reversal"
            if why:
                out.append((j, i, d, why))
                pos, last = None, i
        prev = abs(s)
    if pos:
        out.append((pos[0], len(mid) - 1, pos[1], "eod"))
    return out


def maker_loop(mid, bid, ask, sig, p):
    out, pending, pos, leave, last, prev, counts = [], None, None, None, -(p.cooldown + 1), 0.0, [0, 0, 0]
    for i, (m, b, a, s) in enumerate(zip(mid, bid, ask, sig)):
        if any(map(math.isnan, (m, b, a, s))):
            prev = 0.0
            continue
        if pos is None and pending is None:
            if i - last > p.cooldown and abs(s) >= p.threshold and (not p.fresh_cross or prev < p.threshold):
                pending = (i, 1, b) if s > 0 else (i, -1, a)
                counts[0] += 1
        elif pos is None:
            if (b < pending[2]) if pending[1] > 0 else (a > pending[2]):
                pos, pending = (i, pending[1], pending[2]), None
                counts[1] += 1
            elif i - pending[0] >= p.order_timeout:
                pending = None
                counts[2] += 1
        else:
            if leave is None and p.maker_exit:
                leave = a if pos[1] > 0 else b
            if leave is not None and ((a > leave) if pos[1] > 0 else (b < leave)):
                out.append((pos[0], i, pos[1], "maker_exit"))
                pos, leave, last = None, None, i
            elif i - pos[0] >= p.max_hold:
                out.append((pos[0], i, pos[1], "taker_max_hold"))
                pos, leave, last = None, None, i
        prev = abs(s)
    if pos:
        out.append((pos[0], len(mid) - 1, pos[1], "taker_eod"))
    return out, tuple(counts)


@pytest.mark.parametrize("seed", range(12))
def test_simulators_equal_loops(seed):
    rng = np.random.default_rng(seed)
    n = 300
    mid = 100 + np.cumsum(rng.choice([-0.05, 0, 0, 0.05], n))
    sig = rng.normal(size=n) * 1.2
    bid, ask = mid - 0.05 * rng.integers(1, 3, n), mid + 0.05 * rng.integers(1, 3, n)
    sig[rng.random(n) < 0.05] = np.nan
    mid[rng.random(n) < 0.03] = np.nan
    t = S.Taker(threshold=1.0, cooldown=int(rng.integers(0, 5)), max_hold=int(rng.integers(2, 20)), stop_ticks=2, min_hold=2, reversal=[None, 0.8][seed % 2], fresh_cross=seed % 3 == 0)
    assert [(a, b, d, w) for a, b, d, _, _, w in S.taker_session(mid, sig, t)] == taker_loop(mid, sig, t)
    m = S.Maker(threshold=1.0, cooldown=int(rng.integers(0, 5)), max_hold=int(rng.integers(2, 20)), order_timeout=int(rng.integers(1, 6)), fresh_cross=seed % 2 == 0, maker_exit=seed % 4 != 0)
    got, counts = S.maker_session(mid, bid, ask, sig, m)
    assert ([(a, b, d, w) for a, b, d, _, _, w in got], counts) == maker_loop(mid, bid, ask, sig, m)


def test_taker_scenarios():
    flat = np.full(50, 1650.0)
    turn = np.where(np.arange(50) < 10, 1.0, -2.0)
    assert S.taker_session(flat, turn, S.Taker(threshold=0.5, reversal=0.5, max_hold=10_000))[0][-1] == "reversal"
    fall = 1650 - 0.05 * 6 * np.arange(50)
    assert S.taker_session(fall, np.ones(50), S.Taker(threshold=0.5, stop_ticks=4))[0][-1] == "stop"
    assert [t[-1] for t in S.taker_session(flat[:30], np.ones(30), S.Taker(threshold=0.5, max_hold=10_000))] == ["eod"]


def test_maker_long_wins():
    mid = np.where(np.arange(60) < 15, 100.0, np.where(np.arange(60) < 30, 99.95, 100.50))
    sig = np.where(np.arange(60) == 5, 2.0, 0.0)
    (trade,), counts = S.maker_session(mid, mid - 0.05, mid + 0.05, sig, S.Maker(threshold=1.5, order_timeout=20, max_hold=100))
    assert trade[3] == pytest.approx(99.95) and trade[4] == pytest.approx(100.0) and trade[5] == "maker_exit" and counts == (1, 1, 0)


BUY, SELL = (100, 990, 101, 10), (100, 10, 101, 990)


def play(packets_, p=S.Strategy(), minute=600, halted=False, lot=550):
    s, out = S.fresh_state(p), []
    for q in packets_:
        t = S.step(s, p, lot, minute, *q, halted)
        if t:
            out.append(t)
    return s, out


def test_broker_fills_then_leaves_as_maker():
    hold = [(100, 500, 102, 500)] * 10
    s, out = play([BUY, (99.5, 500, 101, 10), *hold, (100, 500, 102.1, 500)])
    assert (s["posts"], s["fills"]) == (1, 1)
    assert out[0]["exit_method"] == "maker_exit" and out[0]["exit_price"] == 102.0


def test_broker_queue_cutoff_garbage_and_stop():
    s, _ = play([(100, 10_000, 101, 10), (99.5, 9_900, 101, 10)])
    assert s["fills"] == 0 and s["posts"] == 1
    assert play([BUY], minute=15 * 60 + 30)[0]["posts"] == 0 and play([BUY], minute=15 * 60 + 20)[0]["posts"] == 1
    assert play([BUY], halted=True)[0]["posts"] == 0
    s, _ = play([(0, 990, 101, 10), (102, 5, 101, 5)])
    assert (s["posts"], s["i"], s["mid"]) == (0, 0, 0.0)
    _, out = play([BUY, (99.5, 500, 101, 10), (99.0, 500, 99.2, 500)])
    assert out[0]["exit_method"] == "taker_stop"
    assert play([BUY, (99.5, 500, 101, 10), (99.8, 500, 99.9, 500)])[1] == []


def test_broker_edge_gate_and_close_at_the_end():
    assert play([(2460, 990, 2461, 10)], lot=175)[0]["posts"] == 0 and play([(2460, 990, 2462, 10)], lot=175)[0]["posts"] == 1
    assert play([(743, 990, 744, 10)])[0]["posts"] == 1
    s, _ = play([BUY, (99.5, 500, 101, 10)])
    assert S.force_close(dict(s), S.Strategy(), 550)["exit_price"] == pytest.approx(100.20)
    s["mid"] = 0.0
    assert S.force_close(s, S.Strategy(), 550)["exit_price"] == pytest.approx(99.95)


def test_risk_latches():
    r = S.DayRisk(-7500)
    states = []
    for x in (-5000, -3000, 10_000):
        r.record(x)
        states.append(r.halted)
    assert states == [False, True, True]


# Sources


def test_depth_frames(spark):
    levels = b"".join(struct.pack("<dII", 100 + i, 10 * i, i) for i in range(20))
    bid, ask = (struct.pack("<hBBiI", 332, code, 2, 77, n) + levels for code, n in ((41, 5), (51, 6)))
    df = spark.createDataFrame([(1, bid + ask), (2, bid[:4]), (3, b""), (4, None), (5, struct.pack("<hBBiI", 12, 99, 6, 1, 1))], "id int, frame binary")
    good, bad = packets.decode(df)
    rows = good.collect()
    assert [(r["kind"], r["segment"], r["security_id"], r["sequence"]) for r in rows if r["id"] == 1] == [("bid", "NSE_FNO", 77, 5), ("ask", "NSE_FNO", 77, 6)]
    assert rows[0]["price"][3] == 103.0 and rows[0]["qty"][3] == 30 and rows[0]["orders"][3] == 3
    assert [(r["kind"], r["segment"]) for r in rows if r["id"] == 5] == [("unknown", "UNKNOWN_6")]
    assert [r["id"] for r in bad.collect()] == [2]


def test_market_frames(spark):
    frame = struct.pack("<BhBi", 2, 16, 1, 9) + struct.pack("<fi", 12.5, 1_700_019_800)
    good, bad = packets.decode(spark.createDataFrame([(bytes(frame),), (bytes(frame[:10]),)], "frame binary"), depth=False)
    r = good.first()
    assert r["kind"] == "ticker" and r["fields"] == {"ltp": 12.5, "ltt": 1_700_000_000.0} and bad.count() == 1


def test_trade_logs_and_arms(spark, tmp_path):
    for arm, nets in (("control", ["60", "x"]), ("no_stop", ["80"])):
        (tmp_path / arm).mkdir()
        head = [c.split()[0] for c in logs.TRADE_LOG.split(", ")]
        lines = [",".join(head)] + [",".join({"underlying": "A", "date": "2026-06-01", "net_pnl": n}.get(h, "") for h in head) for n in nets]
        (tmp_path / arm / "paper_trades.csv").write_text("\n".join(lines) + "\n")
    df = logs.trade_logs(spark, str(tmp_path))
    assert {r["arm"]: r["s"] for r in df.groupBy("arm").agg(F.sum("net_pnl").alias("s")).collect()} == {"control": 60.0, "no_stop": 80.0}
    assert logs.trade_logs(spark, str(tmp_path), days=["2026-06-02"]).count() == 0
    assert df.first()["queue_ahead"] is None


def test_front_month(spark, tmp_path):
    head = "EXCH_ID,SEGMENT,SECURITY_ID,INSTRUMENT,UNDERLYING_SYMBOL,LOT_SIZE,SM_EXPIRY_DATE"
    rows = ["NSE,D,1,FUTSTK,ABC,550,2026-05-28", "NSE,D,2,FUTSTK,ABC,550,2026-07-30", "NSE,D,3,FUTSTK,ABC,550,2026-06-25", "NSE,D,bad,FUTSTK,ABC,550,2026-06-20", "NSE,D,5,FUTSTK,XYZ,100,never"]
    (tmp_path / "m.csv").write_text("\n".join([head, *rows]))
    m = logs.instruments(spark, str(tmp_path / "m.csv"))
    assert m.count() == 3
    assert [r["security_id"] for r in logs.front_month(m, datetime(2026, 6, 1).date()).collect()] == [3]
    wanted = spark.createDataFrame([("ABC",), ("XYZ",)], "symbol string")
    assert [r["symbol"] for r in logs.unresolved(wanted, m).collect()] == ["XYZ"]


def test_recordings_prefer_compacted_files(spark, tmp_path):
    def put(day, symbol, name, prices):
        folder = tmp_path / f"trading_date={day}" / f"symbol={symbol}"
        folder.mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"bid_price_01": prices}).to_parquet(folder / name)

    put("2026-06-01", "ABC-Jun2026-FUT", "compacted-0.parquet", [1.0, 2.0])
    put("2026-06-01", "ABC-Jun2026-FUT", "raw-0.parquet", [9.0])
    put("2026-06-02", "ABC-Jun2026-FUT", "raw-0.parquet", [3.0])
    put("2026-06-02", "ABC-Jun2026-FUT", "raw-1.parquet", [4.0])
    df = depth.recordings(spark, str(tmp_path), symbols=["ABC"])
    assert sorted(r["bid_price_01"] for r in df.collect()) == [1.0, 2.0, 3.0, 4.0]
    assert depth.one_contract(df).count() == 4
    put("2026-06-02", "ABC-Jul2026-FUT", "raw-0.parquet", [5.0])
    with pytest.raises(Exception, match="several contracts"):
        depth.one_contract(depth.recordings(spark, str(tmp_path))).count()
    assert depth.recordings(spark, str(tmp_path), dates=["2026-06-01"]).count() == 2
    # A damaged file is an error, or with `tolerant` as if it weren't there.
    (tmp_path / "trading_date=2026-06-02" / "symbol=ABC-Jun2026-FUT" / "compacted-0.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    with pytest.raises(Exception):  # noqa: B017
        depth.recordings(spark, str(tmp_path), dates=["2026-06-02"]).collect()
    assert sorted(r["bid_price_01"] for r in depth.recordings(spark, str(tmp_path), dates=["2026-06-02"], tolerant=True).collect()) == [3.0, 4.0, 5.0]


def test_history_in_ranges(spark):
    def fetch(symbol, first, last):
        from datetime import datetime as dt
        from datetime import timedelta as td

        return [(dt(d.year, d.month, d.day), 1.0, 2.0, 0.5, 1.5, 10) for d in (first + td(days=k) for k in range((last - first).days + 1))] * 2

    spark.dataSource.register(history.history_source(fetch, 30))
    df = history.bars(spark, "bar_history", ["A", "B"], "2026-01-01", "2026-03-15")
    assert df.count() == 2 * 74
    assert [(r.first.isoformat(), r.last.isoformat()) for r in history.ranges(["A"], datetime(2026, 1, 1).date(), datetime(2026, 2, 4).date(), 30)] == [("2026-01-01", "2026-01-30"), ("2026-01-31", "2026-02-04")]


def test_retries_pass_over_busy_answers():
    class Busy(Exception):
        status = 429

    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return ["ok"]

    assert history.retried(call, wait=0) == ["ok"] and len(calls) == 3


# Streams


def test_broker_stream_equals_batch(spark, small):
    from tidebook.plans import QUERIES

    keys = ("arm", "date", "symbol", "exit_seq", "exit_method", "net_pnl")
    batch = {tuple(str(r[k]) for k in keys) for r in QUERIES["e3_broker"](spark, small).collect()}
    stream = {tuple(str(r[k]) for k in keys) for r in QUERIES["t5_broker_stream"](spark, small).collect()}
    last = max(b[1] for b in batch)
    assert stream <= batch and all(b[1] == last and b[4] == "taker_eod" for b in batch - stream)
    assert len(stream) > 20


def test_percentiles(spark):
    rng = random.Random(4)
    sets = {"skewed": [rng.lognormvariate(0, 6) for _ in range(3000)], "ties": [float(rng.randint(-2, 2)) for _ in range(500)], "equal": [7.0] * 9, "one": [-3.5], "pair": [1.0, 2.0]}
    rows = [(k, v) for k, x in sets.items() for v in x] + [("one", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r["k"]: r for r in E.percentiles(df, ("k",), "x", {"a": 0.5, "b": 0.95, "low": 0.0, "high": 1.0}).collect()}
    assert set(got) == set(sets)
    for k, x in sets.items():
        for name, q in (("a", 50), ("b", 95), ("low", 0), ("high", 100)):
            assert got[k][name] == pytest.approx(np.percentile(x, q), rel=1e-12)
    assert E.percentiles(df.limit(0), ("k",), "x", {"a": 0.5}).collect() == []


def _feed(spark, folder, rows):
    """A file of packets as the next batch of a stream."""
    frame = pd.DataFrame(rows, columns=["arm", "symbol", "ts", "seq", "bid", "bid_qty", "ask", "ask_qty"])
    spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(folder)


def test_broker_stream_closes_by_the_clock(spark, tmp_path):
    """An arm without further packets is closed when the feed of another passes the closing minute."""
    p = S.Strategy(entry_threshold=0.05, max_hold=500, min_hold=400, order_timeout=50, edge_margin=0.0, queue_fill=0.0, stop_ticks=0.0)
    day = datetime(2026, 6, 1, 10, 0)
    quotes = [(100.0, 100.0, 100.4, 100.0), (100.0, 900.0, 100.4, 100.0), (99.8, 900.0, 100.2, 100.0), (100.6, 100.0, 101.0, 100.0)]
    held = [("a", "x", day + timedelta(seconds=k), k, *q) for k, q in enumerate(quotes)]
    folder, out, check = (str(tmp_path / n) for n in ("in", "live.json", "check"))
    _feed(spark, folder, held)

    def run():
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        live.publish(live.broker_stream(stream, p, close=15 * 60 + 30, positions=True), out, check, None).awaitTermination()
        return logs.read_snapshot(out)["arms"]

    arm = run()["a"]
    want = {r["symbol"]: r for r in S.broker_positions(spark.read.parquet(folder).withColumn("date", F.to_date("ts")), p).collect()}["x"]
    told = arm["positions"]["x"]
    assert (told["direction"], told["entry_price"], told["unrealized"]) == (1, 100.0, round(0.8 * 550, 2))
    assert all(told[c] == want[c] for c in S.names_of(S.POSITIONS) if c != "symbol") and want["seq"] == 3
    assert arm["open_positions"] == 1 and arm["trades"] == 0 and arm["unrealized"] == 440.0 and not arm["halted"]
    # Another arm's packets pass 15:30; the first arm gets none, and the packet itself comes after the close.
    _feed(spark, folder, [("b", "x", day.replace(hour=15, minute=31), 4, *quotes[0])])
    arms = run()
    assert arms["a"]["trades"] == 1 and arms["a"]["open_positions"] == 0 and arms["a"]["unrealized"] == 0.0
    assert arms["a"]["net"] == arms["a"]["positions"]["x"]["realized"] == arms["a"]["day_net"]
    assert "b" not in arms
    assert run() == arms  # nothing new: nothing counts twice


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "live.json")
    assert logs.read_snapshot(path) is None and not live.is_live(path)
    batch = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", -1.0)], "arm string, net_pnl double")
    live.telemetry(batch, path, now=100.0)
    live.telemetry(batch, path, now=101.0)
    assert logs.read_snapshot(path) == {"generated_at": 101.0, "arms": {"a": {"trades": 4, "net": 7.0}, "b": {"trades": 2, "net": -2.0}}}
    for _ in range(2):  # a batch that is repeated counts once
        live.telemetry(batch, path, now=102.0, batch_id=3)
    assert logs.read_snapshot(path)["arms"]["a"] == {"trades": 6, "net": 10.5}
    assert live.is_live(path, now=110.0) and not live.is_live(path, now=200.0)
    (tmp_path / "live.json").write_text("{")
    assert logs.read_snapshot(path) is None
