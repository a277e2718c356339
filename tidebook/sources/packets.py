"""Wire packets of the live feeds, decoded in Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the wire format.
DEPTH_HEAD, LEVEL, DEPTH_SIZES = struct.Struct("<hBBiI"), struct.Struct("<dII"), {41: 332, 51: 332, 50: 14}
MARKET_HEAD, MARKET_SIZES = struct.Struct("<BhBi"), {2: 16, 4: 50, 5: 12, 6: 16, 50: 10}
MARKET_BODY = {2: ("<fi", ("ltp", "ltt")), 4: ("<fhifiiiffff", ("ltp", "ltq", "ltt", "atp", "volume", "sell_qty", "buy_qty", "day_open", "day_close", "day_high", "day_low")), 5: ("<i", ("open_interest",)), 6: ("<fi", ("prev_close", "prev_open_interest")), 50: ("<h", ("disconnect",))}
SEGMENTS = {0: "IDX_I", 1: "NSE_EQ", 2: "NSE_FNO", 3: "NSE_CURRENCY", 4: "BSE_EQ", 5: "MCX_COMM", 7: "BSE_CURRENCY", 8: "BSE_FNO"}
KINDS = {41: "bid", 51: "ask", 50: "disconnect"}
MARKET_KINDS = {2: "ticker", 4: "quote", 5: "oi", 6: "prev_close", 50: "disconnect"}

PACKET = "kind string, code int, segment string, security_id long, sequence long, price array<double>, qty array<long>, orders array<long>, fields map<string,double>"
HOURS_AHEAD_S = 19_800


def _packet(kind, code, segment, security, sequence=None, levels=(), fields=None) -> tuple:
    price, qty, orders = (list(x) for x in zip(*levels)) if levels else ([], [], [])
    return kind, code, SEGMENTS.get(segment, f"UNKNOWN_{segment}"), security, sequence, price, qty, orders, fields or {}


def depth_packets(frame: bytes) -> list[tuple]:
    """Packets of one depth message; ValueError where it is cut short or of a wrong length."""
    out, at = [], 0
    while at < len(frame):
        if len(frame) - at < DEPTH_HEAD.size:
            raise ValueError("cut short in a header")
        size, code, segment, security, sequence = DEPTH_HEAD.unpack_from(frame, at)
        if size <= 0 or len(frame) - at < size or DEPTH_SIZES.get(code, size) != size:
            raise ValueError(f"length {size} of code {code} with {len(frame) - at} bytes left")
        body = frame[at + DEPTH_HEAD.size : at + size]
        levels = list(LEVEL.iter_unpack(body)) if code in (41, 51) else ()
        fields = {"disconnect": float(struct.unpack("<h", body)[0])} if code == 50 else {}
        out.append(_packet(KINDS.get(code, "unknown"), code, segment, security, sequence, levels, fields))
        at += size
    return out


def market_packets(frame: bytes) -> list[tuple]:
    """Packets of one market message; trade times are moved from the exchange's clock to UTC."""
    out, at = [], 0
    while at < len(frame):
        if len(frame) - at < MARKET_HEAD.size:
            raise ValueError("cut short in a header")
        code, size, segment, security = MARKET_HEAD.unpack_from(frame, at)
        if size <= 0 or len(frame) - at < size or MARKET_SIZES.get(code, size) != size:
            raise ValueError(f"length {size} of code {code} with {len(frame) - at} bytes left")
        fields = {}
        if code in MARKET_BODY:
            layout, names = MARKET_BODY[code]
            fields = {k: float(v) for k, v in zip(names, struct.unpack_from(layout, frame, at + MARKET_HEAD.size))}
            if "ltt" in fields:
                fields["ltt"] -= HOURS_AHEAD_S
        out.append(_packet(MARKET_KINDS.get(code, "unknown"), code, segment, security, fields=fields))
        at += size
    return out


NAMES = tuple(c.split()[0] for c in PACKET.split(", "))

# The same for whole Arrow batches: the k-th packets of all frames are read side by side.
_DEPTH = np.dtype([("size", "<i2"), ("code", "u1"), ("segment", "u1"), ("security", "<i4"), ("sequence", "<u4")])
_MARKET = np.dtype([("code", "u1"), ("size", "<i2"), ("segment", "u1"), ("security", "<i4")])
_LEVELS = np.dtype([("price", "<f8"), ("qty", "<u4"), ("orders", "<u4")])
_NUMBER = {"f": "<f4", "h": "<i2", "i": "<i4"}
_BODY = {code: np.dtype([(name, _NUMBER[c]) for name, c in zip(names, layout[1:])]) for code, (layout, names) in MARKET_BODY.items()}
_LOST = np.dtype([("disconnect", "<i2")])


def _bytes(data: np.ndarray, at: np.ndarray, kind: np.dtype, times: int = 1) -> np.ndarray:
    """The records of a kind that begin at these places."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(kind.itemsize * times)]).view(kind)


class _Found:
    """Packets of a batch, in parts."""

    def __init__(self) -> None:
        self.parts: list[dict] = []

    def add(self, frame, place, kind: str, head: np.ndarray, sequence=None, levels=None, fields=None) -> None:
        if len(frame):
            self.parts.append({"frame": frame, "place": place, "kind": kind, "head": head, "sequence": sequence, "levels": levels, "fields": fields})

    def table(self, good: np.ndarray) -> pa.Table:
        """A row per packet of the good frames, with the frame's number, in the order of frames and packets."""
        out = [pa.table({c: pa.array([], t) for c, t in (("frame", pa.int64()), ("place", pa.int64()), *_ARROW.items())})]
        for p in self.parts:
            on = np.flatnonzero(good[p["frame"]])
            n, head = len(on), p["head"][on]
            levels = p["levels"][on] if p["levels"] is not None else np.zeros((n, 0), _LEVELS)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * levels.shape[1])
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(levels[c]).ravel().astype(t))) for c, t in (("price", float), ("qty", np.int64), ("orders", np.int64))]
            fields = p["fields"][on] if p["fields"] is not None else np.zeros(n, np.dtype([]))
            names = fields.dtype.names or ()
            values = np.column_stack([fields[c].astype(float) - HOURS_AHEAD_S * (c == "ltt") for c in names]).ravel() if names and n else np.zeros(0)
            maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), pa.array(list(names) * n, pa.string()), pa.array(values, pa.float64()))
            segment = [SEGMENTS.get(k, f"UNKNOWN_{k}") for k in head["segment"].tolist()]
            sequence = pa.nulls(n, pa.int64()) if p["sequence"] is None else pa.array(p["sequence"][on].astype(np.int64))
            made = [pa.array(p["frame"][on]), pa.array(np.full(n, p["place"])), pa.array([p["kind"]] * n, pa.string()), pa.array(head["code"].astype(np.int32)), pa.array(segment, pa.string()), pa.array(head["security"].astype(np.int64)), sequence, *lists, maps]
            out.append(pa.table(made, names=["frame", "place", *_ARROW]).cast(out[0].schema))
        return pa.concat_tables(out).sort_by([("frame", "ascending"), ("place", "ascending")]).drop_columns(["place"])


_ARROW = {
    "kind": pa.string(), "code": pa.int32(), "segment": pa.string(), "security_id": pa.int64(), "sequence": pa.int64(),
    "price": pa.list_(pa.float64()), "qty": pa.list_(pa.int64()), "orders": pa.list_(pa.int64()), "fields": pa.map_(pa.string(), pa.float64()),
}


def read_frames(frames: pa.Array, depth: bool = True) -> tuple[pa.Table, dict[int, str]]:
    """(packets with the number of their frame, what is wrong with the others): depth_packets or market_packets of each."""
    frames = frames.cast(pa.binary())
    head_kind, sizes = (_DEPTH, DEPTH_SIZES) if depth else (_MARKET, MARKET_SIZES)
    lengths = pc.binary_length(frames).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = b"".join([f or b"" for f in frames.to_pylist()])
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(lengths)
    at, place = ends - lengths, 0
    found, errors, open_ = _Found(), {}, np.flatnonzero(lengths > 0)
    while len(open_):
        left = ends[open_] - at[open_]
        short = left < head_kind.itemsize
        errors.update(dict.fromkeys(open_[short].tolist(), "cut short in a header"))
        open_, left = open_[~short], left[~short]
        head = _bytes(data, at[open_], head_kind)[:, 0] if len(open_) else np.zeros(0, head_kind)
        size, code = head["size"].astype(np.int64), head["code"]
        wanted = size.copy()
        for c, n in sizes.items():
            wanted[code == c] = n
        bad = (size <= 0) | (left < size) | (wanted != size)
        errors.update({int(f): f"length {n} of code {c} with {b} bytes left" for f, n, c, b in zip(open_[bad], size[bad], code[bad], left[bad])})
        open_, head, code, size = open_[~bad], head[~bad], code[~bad], size[~bad]
        for c in np.unique(code).tolist():
            on = code == c
            frame, body = open_[on], at[open_[on]] + head_kind.itemsize
            if depth:
                levels = _bytes(data, body, _LEVELS, 20) if c in (41, 51) else None
                fields = _bytes(data, body, _LOST)[:, 0] if c == 50 else None
                found.add(frame, place, KINDS.get(c, "unknown"), head[on], head["sequence"][on], levels, fields)
            else:
                fields = _bytes(data, body, _BODY[c])[:, 0] if c in _BODY else None
                found.add(frame, place, MARKET_KINDS.get(c, "unknown"), head[on], fields=fields)
        at[open_] += size
        open_ = open_[at[open_] < ends[open_]]
        place += 1
    good = np.ones(len(frames), bool)
    good[list(errors)] = False
    return found.table(good), errors


def decoded(df: DataFrame, column: str = "frame", depth: bool = True) -> DataFrame:
    """df's other columns with a row per packet; a frame that can't be decoded is one row with its `error` and the frame as `dead`.

    A frame with a damaged packet gives no packet. A null or empty frame gives no row.
    """
    others = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), PACKET, "dead binary, error string"])

    def run(batches):
        for batch in batches:
            frames = batch.column(column)
            found, errors = read_frames(frames, depth)
            rest = batch.select([f.name for f in others])
            rows = pa.table(rest.take(found.column("frame").combine_chunks()).columns + [c for c in found.drop_columns(["frame"]).columns], names=[*rest.schema.names, *NAMES])
            rows = rows.append_column("dead", pa.nulls(rows.num_rows, pa.binary())).append_column("error", pa.nulls(rows.num_rows, pa.string()))
            yield from rows.combine_chunks().to_batches()
            if errors:
                at = pa.array(sorted(errors), pa.int64())
                bad = rest.take(at)
                nulls = [pa.nulls(len(at), t) for t in _ARROW.values()]
                yield pa.RecordBatch.from_arrays([*bad.columns, *nulls, frames.take(at).cast(pa.binary()), pa.array([errors[k] for k in at.to_pylist()], pa.string())], names=[*rest.schema.names, *NAMES, "dead", "error"])

    return df.select(*[f.name for f in others], column).mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "frame", depth: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a row per packet with df's other columns, frames that can't be decoded with their error); see decoded."""
    rows = decoded(df, column, depth)
    others = [c for c in df.columns if c != column]
    return rows.filter("error IS NULL").drop("dead", "error"), rows.filter("error IS NOT NULL").select(*others, F.col("dead").alias(column), "error")


def depth_frames(df: DataFrame, name: str = "frame") -> DataFrame:
    """df(code, segment, security_id, sequence, price, qty, orders, ...) with each row's packet of 20 levels as a frame."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            head, levels = np.zeros(n, _DEPTH), np.zeros((n, 20), _LEVELS)
            head["size"] = DEPTH_SIZES[41]
            for c, field in (("code", "code"), ("segment", "segment"), ("security_id", "security"), ("sequence", "sequence")):
                head[field] = batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("price", "qty", "orders"):
                levels[c] = batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, 20)
            made = np.concatenate([head.view(np.uint8).reshape(n, -1), levels.view(np.uint8).reshape(n, -1)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in made], pa.binary())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{fields}, `{name}` binary")
