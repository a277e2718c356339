"""Features of a session's packets, as windows over whole sessions and as a fold over packets as they come.

Both give the same values: the fold adds up each window in the windows' own order, from
buffers that hold no more packets than the widest window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.columns import EPS, SESSION, gated, rolling, session, zscore

from . import features as X
from . import recurrences as R

#: Packets between which the mid's velocity is taken; those of the flow's sum; those of the spread's z-score and the
#: least of them; weight of the newest mid in its exponential mean; order sizes in calibrated sizes.
LAG, FLOW, WIDTH, LEAST, ALPHA, SIZES = 10, 20, 50, 10, 2 / 33, 10
QUOTE = ("bid", "ask", "bid_qty", "ask_qty")
FEATURES = ("mid", "micro_deviation", "velocity", "flow", "flow_sum", "log_spread_z", "mid_ema", "bid_size_ratio", "ask_size_ratio")


def session_features(quotes: DataFrame, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """quotes(keys, ts, seq, bid, ask, bid_qty, ask_qty, calib, ...) with the columns FEATURES and order_size.

    calib is the session's calibrated size; rows without one go, and so does their session.
    """
    w = session(*keys)
    df = X.flow_first(X.microprice(X.quote_columns(quotes.filter("calib IS NOT NULL"))), keys)
    df = df.withColumn("flow", F.col("ofi_l1").cast("double")).withColumn("_log", F.ln(F.greatest(F.col("spread"), F.lit(1e-6))))
    df = df.withColumns(
        {
            "velocity": F.col("mid") - F.lag("mid", LAG).over(w),
            "flow_sum": gated(F.sum("flow").over(rolling(w, FLOW)), F.col("flow"), rolling(w, FLOW), FLOW),
            "log_spread_z": zscore(F.col("_log"), w, WIDTH, LEAST),
            "bid_size_ratio": F.col("bid_qty") / F.col("calib"),
            "ask_size_ratio": F.col("ask_qty") / F.col("calib"),
            "order_size": SIZES * F.col("calib"),
        }
    )
    df = df.drop("_log", "ofi_l1", "spread", "spread_ticks", "obi_1")
    return R.ema(df, "mid", "mid_ema", alpha=ALPHA, keys=keys)


def taker_rows(features: DataFrame, signal: str, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """The three columns that a taker needs, beside the session and the order of its packets."""
    return features.select(*keys, "seq", "ts", "mid", F.col(signal).alias("signal"))


def maker_rows(features: DataFrame, signal: str, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """The five columns that a maker needs: a taker's, and the first level's prices."""
    return features.select(*keys, "seq", "ts", "mid", "bid", "ask", F.col(signal).alias("signal"))


def _running(x: np.ndarray, first: int, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared distances over the last n of x, for x[first:], added up oldest first."""
    at = np.arange(first, len(x))
    mean, square, held = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for k in range(n - 1, -1, -1):
        there = at >= k
        value = x[np.maximum(at - k, 0)]
        held += there
        apart = np.where(there, value - mean, 0.0)
        step = np.divide(apart, held, out=np.zeros(len(at)), where=there)
        mean += step
        square += apart * (apart - step)
    return np.where(held >= least, held, np.nan), square


class SessionFold:
    """session_features packet by packet: step() takes a session's next packets in order.

    What a session carries from one call to the next: its number of packets, the last mids, log spreads and flows,
    the last quote, the exponential mean, and the calibrated size.
    """

    state = "n long, mids array<double>, logs array<double>, flows array<double>, quote array<double>, ema double, calib double"
    adds = ", ".join(f"{c} double" for c in (*FEATURES, "order_size"))

    @staticmethod
    def start(calib: float | None) -> tuple:
        return (0, [], [], [], [], 0.0, calib)

    @staticmethod
    def step(rows: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        n, mids, logs, flows, quote, ema, calib = held
        if calib is None or calib != calib:
            return rows.iloc[:0].assign(**{c: 0.0 for c in (*FEATURES, "order_size")}), held
        bid, ask, bid_qty, ask_qty = (rows[c].to_numpy(float) for c in QUOTE)
        old, new = len(mids), len(rows)
        mid = (bid + ask) / 2
        before = np.vstack([quote or [0.0] * 4, np.column_stack([bid, ask, bid_qty, ask_qty])])[:-1].T
        buy = np.where(bid > before[0], bid_qty, np.where(bid < before[0], -before[2], bid_qty - before[2]))
        sell = np.where(ask < before[1], ask_qty, np.where(ask > before[1], -before[3], ask_qty - before[3]))
        flow = buy - sell
        if n == 0 and new:
            flow[0] = 0.0
        all_mids, all_logs, all_flows = (np.concatenate([np.array(a, float), b]) for a, b in ((mids, mid), (logs, np.log(np.maximum(ask - bid, 1e-6))), (flows, flow)))
        at = np.arange(old, old + new)
        velocity = np.where(at >= LAG, mid - all_mids[np.maximum(at - LAG, 0)], np.nan)
        flow_sum = np.zeros(new)
        for k in range(FLOW - 1, -1, -1):
            flow_sum = flow_sum + all_flows[np.maximum(at - k, 0)]
        mean = np.zeros(new)
        for k in range(WIDTH - 1, -1, -1):
            mean = mean + np.where(at >= k, all_logs[np.maximum(at - k, 0)], 0.0)
        count, square = _running(all_logs, old, WIDTH, LEAST)
        sd = np.sqrt(square / (count - 1))
        means = []
        for k, x in enumerate(mid.tolist(), n):
            ema = x if k == 0 else ((1 - ALPHA) * ema + ALPHA * x) / ((1 - ALPHA) + ALPHA)
            means.append(ema)
        out = rows.assign(
            mid=mid,
            micro_deviation=(bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty + EPS) - (bid + ask) / 2,
            velocity=velocity,
            flow=flow,
            flow_sum=np.where(at >= FLOW - 1, flow_sum, np.nan),
            log_spread_z=(all_logs[old:] - mean / count) / (np.where(sd < 1e-12, 0.0, sd) + EPS),
            mid_ema=means,
            bid_size_ratio=bid_qty / calib,
            ask_size_ratio=ask_qty / calib,
            order_size=SIZES * calib,
        )
        last = lambda a: a[max(0, len(a) - WIDTH) :].tolist()
        kept = [float(v[-1]) for v in (bid, ask, bid_qty, ask_qty)] if new else quote
        return out, (n + new, last(all_mids), last(all_logs), last(all_flows), kept, float(ema), calib)
