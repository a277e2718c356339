"""Recurrences as scans, so that a session's packets are worked on by several tasks.

A session is cut into chunks of time. What a chunk does to the state that it is entered with is
summed up on its own; a session's summaries, a row a chunk, are put one after the other, which tells each
chunk the state it starts from; then each chunk is gone through once more from there. Rows are dealt to the tasks once, by
session and chunk; summaries and states are a few numbers a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.columns import SESSION

State = tuple[float, ...]


def scanned(
    df: DataFrame,
    keys: tuple[str, ...],
    micros: int,
    added: str,
    summary: Callable[[pd.DataFrame], list[float]],
    enter: Callable[[State | None, list[float]], State],
    work: Callable[[pd.DataFrame, State | None], pd.DataFrame],
    on: str = "ts",
    tie: str = "seq",
) -> DataFrame:
    """df with the columns `added` of a recurrence over keys in the order of (on, tie), in chunks of so many microseconds.

    summary(rows) tells what a chunk does, enter(state, summary) the state after it (None: before the first chunk),
    work(rows, state) adds the columns, given the state before the chunk. Rows of a chunk come sorted.
    """
    at = F.col(on).cast("timestamp")
    cut = df.withColumn("_chunk", F.floor(F.unix_micros(at) / micros))
    group = [*keys, "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in group)
    order = [on, tie]
    # The chunks' exchange is named, so that both passes read the same one.
    dealt = cut.repartition(*group)

    def sum_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, [float(x) for x in summary(rows.sort_values(order))])], columns=[*group, "does"])

    def follow(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_chunk", ignore_index=True)
        state, before = None, []
        for does in chunks["does"]:
            before.append(None if state is None else [float(x) for x in state])
            state = enter(state, list(does))
        return chunks[group].assign(state=before)

    def go(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        state = states["state"].iloc[0]
        return work(rows.sort_values(order), None if state is None else tuple(state)).drop(columns="_chunk")

    does = dealt.groupBy(*group).applyInPandas(sum_up, f"{names}, does array<double>")
    states = does.groupBy(*keys).applyInPandas(follow, f"{names}, state array<double>")
    out = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items() if c != "_chunk"), added])
    return dealt.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(go, out)


def _decayed(weight: float, rows: float, alpha: float) -> float:
    return weight * (1 - alpha) ** rows


def _blend(value: float, weight: float, x: float, alpha: float) -> float:
    """The mean after x, where the mean before has this weight."""
    return (weight * value + alpha * x) / (weight + alpha)


def ema_scan(df: DataFrame, value: str, name: str, alpha: float, micros: int, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """recurrences.ema with sessions cut into chunks.

    The state is the mean and the weight that it has in the next row. From its first value on, a chunk is an affine map of the
    mean after that value, whose factor and offset are the summary.
    """

    def summary(rows: pd.DataFrame) -> list[float]:
        x = rows[value].to_numpy(float)
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return [len(x), len(x), 0.0, 0.0, 0.0, 0.0]
        kept = (1 - alpha) ** np.diff(at)
        tail = np.concatenate([[0.0], x[at[0] + 1 :]])
        offset = float(pd.Series(tail).ewm(alpha=alpha, adjust=False).mean().iloc[-1])
        return [len(x), at[0], x[at[0]], float(np.prod(kept / (kept + alpha))), offset, len(x) - 1 - at[-1]]

    def enter(state: State | None, does: list[float]) -> State | None:
        n, nulls, first, factor, offset, tail = does
        if nulls == n:
            return None if state is None else (state[0], _decayed(state[1], n, alpha))
        entered = first if state is None else _blend(state[0], _decayed(state[1], nulls, alpha), first, alpha)
        return factor * entered + offset, (1 - alpha) ** (tail + 1)

    def work(rows: pd.DataFrame, state: State | None) -> pd.DataFrame:
        x = rows[value].to_numpy(float).copy()
        at = np.flatnonzero(~np.isnan(x))
        first = at[0] if len(at) else len(x)
        out = np.full(len(x), np.nan if state is None else state[0])
        if len(at):
            if state is not None:
                x[first] = _blend(state[0], _decayed(state[1], first, alpha), x[first], alpha)
            out[first:] = pd.Series(x[first:]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        return rows.assign(**{name: out})

    return scanned(df, keys, micros, f"`{name}` double", summary, enter, work)


def _element(z: np.ndarray, t: np.ndarray, q: float, r: float) -> tuple[np.ndarray, ...]:
    """The filter's steps as elements (A, b, C, eta, J) that can be put together in any grouping.

    Conditioned on the state before, the state after has mean A x + b and covariance C, and the
    measurement has the information eta and J about the state before.
    """
    n = len(z)
    one, zero = np.ones(n), np.zeros(n)
    q11, q12, q22 = q * t**3 / 3, q * t * t / 2, q * t
    s = q11 + r
    k1, k2 = q11 / s, q12 / s
    move = np.stack([np.stack([one, t], 1), np.stack([zero, one], 1)], 1)
    keep = np.stack([np.stack([1 - k1, zero], 1), np.stack([-k2, one], 1)], 1)
    noise = np.stack([np.stack([q11, q12], 1), np.stack([q12, q22], 1)], 1)
    seen = np.stack([one, t], 1)
    return keep @ move, np.stack([k1 * z, k2 * z], 1), keep @ noise, seen * (z / s)[:, None], seen[:, :, None] * seen[:, None, :] / s[:, None, None]


def _after(e: tuple[np.ndarray, ...], f: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Elements e with f after each."""
    (ae, be, ce, ne, je), (af, bf, cf, nf, jf) = e, f
    left = af @ np.linalg.inv(np.eye(2) + ce @ jf)
    right = np.swapaxes(ae, -1, -2) @ np.linalg.inv(np.eye(2) + jf @ ce)
    by = lambda m, v: (m @ v[..., None])[..., 0]
    return left @ ae, by(left, be + by(ce, nf)) + bf, left @ ce @ np.swapaxes(af, -1, -2) + cf, by(right, nf - by(jf, be)) + ne, right @ jf @ ae + je


def _together(e: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """One element of all, by pairs of pairs."""
    while len(e[0]) > 1:
        n = len(e[0]) // 2 * 2
        both = _after(tuple(x[0:n:2] for x in e), tuple(x[1:n:2] for x in e))
        e = both if n == len(e[0]) else tuple(np.concatenate([x, y[n:]]) for x, y in zip(both, e))
    return tuple(x[0] for x in e)


def kalman_scan(df: DataFrame, micros: int, value: str = "mid", q: float = 1e-6, r: float = 1e-2, dt0: float = 1.0, dt: str | None = None, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """recurrences.kalman with sessions cut into chunks.

    The state is the level, the velocity and their covariance. A chunk's summary is one filtering element, put
    together from its packets' elements (the associative form of the filter, Sarkka and Garcia-Fernandez 2021),
    beside its first packet, as a session's first packet sets the state.
    """
    from .recurrences import kalman_levels

    def gaps(rows: pd.DataFrame) -> np.ndarray:
        t = rows[dt].fillna(dt0).to_numpy(float) if dt else np.full(len(rows), dt0)
        return np.where(t > 0, t, dt0)

    def summary(rows: pd.DataFrame) -> list[float]:
        z, t = rows[value].to_numpy(float), gaps(rows)
        rest = _together(_element(z[1:], t[1:], q, r)) if len(z) > 1 else ()
        return [z[0], t[0], *(float(x) for part in rest for x in np.ravel(part))]

    def moved(state: State, element: tuple[np.ndarray, ...]) -> State:
        a, b, c, eta, j = element
        x, p = np.array(state[:2]), np.array([[state[2], state[3]], [state[3], state[4]]])
        gain = a @ np.linalg.inv(np.eye(2) + p @ j)
        x, p = gain @ (x + p @ eta) + b, gain @ p @ a.T + c
        return x[0], x[1], p[0, 0], (p[0, 1] + p[1, 0]) / 2, p[1, 1]

    def enter(state: State | None, does: list[float]) -> State:
        z, t, *rest = does
        state = (z, 0.0, 1.0, 0.0, 1.0) if state is None else moved(state, tuple(x[0] for x in _element(np.array([z]), np.array([t]), q, r)))
        if not rest:
            return state
        parts = np.split(np.array(rest), [4, 6, 10, 12])
        return moved(state, tuple(x.reshape(2, 2) if len(x) == 4 else x for x in parts))

    def work(rows: pd.DataFrame, state: State | None) -> pd.DataFrame:
        level, speed = kalman_levels(rows[value].to_numpy(float), gaps(rows), q, r, dt0, state)
        return rows.assign(kf_level=level, kf_velocity=speed)

    return scanned(df, keys, micros, "kf_level double, kf_velocity double", summary, enter, work)
