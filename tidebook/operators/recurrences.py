"""Recurrences over a session, which windows cannot say: smoothing, filtering, pair positions.

A session is one group; its rows are sorted inside. Callers select the columns that they need
first, since a grouped map reads all it is given. scans.py has the same with sessions cut into chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebook.functions.columns import EPS, SESSION


def _grouped(df: DataFrame, keys: tuple[str, ...], added: str, work):
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + added

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return work(rows.sort_values(["ts", "seq"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


def ema(df: DataFrame, value: str, name: str, alpha: float | None = None, span: int | None = None, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Exponential mean seeded by the first value; over missing values weights decay on."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{name: rows[value].astype(float).ewm(alpha=alpha, span=span, adjust=False).mean()})

    return _grouped(df, keys, f"{name} double", work)


def emas(df: DataFrame, values: dict[str, str], span: int, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """Several exponential means of one span, name by value column, in one grouped map."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{n: rows[v].astype(float).ewm(span=span, adjust=False).mean() for v, n in values.items()})

    return _grouped(df, keys, ", ".join(f"{n} double" for n in values.values()), work)


#: Rows whose rolling values are worked out at once.
BLOCK = 1 << 14


def rolling_z(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """functions.columns.zscore of a session's values, NaN where there is none.

    Each window is added up oldest first, as Spark's windows do, but those of a block of rows side by side.
    """
    padded, out = np.concatenate([np.full(n - 1, np.nan), x]), np.empty(len(x))
    for first in range(0, len(x), BLOCK):
        size = min(BLOCK, len(x) - first)
        held, total, mean, square = np.zeros((4, size))
        for k in range(n):
            value = padded[first + k : first + k + size]
            there = ~np.isnan(value)
            held += there
            total += np.where(there, value, 0.0)
            apart = np.where(there, value - mean, 0.0)
            step = apart / np.maximum(held, 1.0)
            mean += step
            square += apart * (apart - step)
        sd = np.sqrt(square / np.maximum(held - 1, 1.0))
        z = (x[first : first + size] - total / np.maximum(held, 1.0)) / (np.where(sd < 1e-12, 0.0, sd) + EPS)
        out[first : first + size] = np.where(held >= max(least, 2), z, np.nan)
    return out


def mean_z_ema(df: DataFrame, signals: tuple[str, ...], chosen: str, name: str, n: int, least: int, span: int, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """keys, ts, seq and the exponential mean of the mean rolling z of those signals whose bit is set in `chosen`, alike in all rows."""
    kept = [*keys, *(c for c in ("ts", "seq") if c not in keys)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{name}` double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "seq"])
        on = [s for i, s in enumerate(signals) if int(rows[chosen].iloc[0]) >> i & 1]
        raw = np.zeros(len(rows))
        for s in on:
            raw = raw + rolling_z(rows[s].to_numpy(float), n, least)
        raw = pd.Series(raw / max(len(on), 1), rows.index)
        return rows[kept].assign(**{name: raw.ewm(span=span, adjust=False).mean()})

    return df.select(*kept, *signals, chosen).groupBy(*keys).applyInPandas(run, schema)


def kalman_levels(z: np.ndarray, dt: np.ndarray, q: float, r: float, dt0: float, state: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Level and velocity of a constant-velocity filter.

    state is the level, the velocity and their covariances (xx, xv, vv) before; without it the first value sets it.
    """
    n = len(z)
    level, speed = np.empty(n), np.empty(n)
    x, v, pxx, pxv, pvv = state or (0.0, 0.0, 1.0, 0.0, 1.0)
    for i in range(n):
        if i == 0 and state is None:
            x = z[0]
        else:
            t = dt[i] if dt[i] > 0 else dt0
            x += v * t
            # Covariance of the state moved on, with the noise that velocity took up.
            pxx, pxv, pvv = pxx + t * (2 * pxv + t * pvv) + q * t**3 / 3, pxv + t * pvv + q * t * t / 2, pvv + q * t
            s = pxx + r
            kx, kv = pxx / s, pxv / s
            e = z[i] - x
            x, v = x + kx * e, v + kv * e
            pxx, pxv, pvv = (1 - kx) * pxx, (1 - kx) * pxv, pvv - kv * pxv
        level[i], speed[i] = x, v
    return level, speed


def kalman(df: DataFrame, value: str = "mid", q: float = 1e-6, r: float = 1e-2, dt0: float = 1.0, dt: str | None = None, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """kf_level and kf_velocity. dt names a column of seconds since the last row."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        gaps = rows[dt].fillna(dt0).to_numpy(float) if dt else np.full(len(rows), dt0)
        level, speed = kalman_levels(rows[value].to_numpy(float), gaps, q, r, dt0)
        return rows.assign(kf_level=level, kf_velocity=speed)

    return _grouped(df, keys, "kf_level double, kf_velocity double", work)


def fade_positions(df: DataFrame, z: str = "z", enter: float = 2.0, leave: float = 0.5, stop: float = 4.0, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """pos: against z once |z| > enter, until |z| < leave or |z| > stop; 0 where z is missing.

    Rows are ordered by (ts, seq). A missing z leaves the state as it is.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = 0.0, []
        for i, x in enumerate(rows[z].to_numpy(float)):
            if i == 0 or np.isnan(x):
                out.append(0.0)
                continue
            size = abs(x)
            if state == 0:
                state = -np.sign(x) if size > enter else 0.0
            elif size < leave or size > stop:
                state = 0.0
            out.append(state)
        return rows.assign(pos=out)

    return _grouped(df, keys, "pos double", work)
