"""Whole batches of wire frames against the readers of single frames."""

import random
import struct

import pyarrow as pa
import pytest

from tidebook.sources import packets as P


def depth_packet(rng, code=None):
    code = rng.choice([41, 51, 50, 77]) if code is None else code
    head = lambda n: struct.pack("<hBBiI", n, code, rng.randrange(12), rng.randrange(-5, 10**6), rng.randrange(2**32))
    if code in (41, 51):
        return head(332) + b"".join(struct.pack("<dII", rng.uniform(-1, 1e5), rng.randrange(2**32), rng.randrange(2**32)) for _ in range(20))
    if code == 50:
        return head(14) + struct.pack("<h", rng.randrange(-900, 900))
    return head(12 + 7) + bytes(7)


def market_packet(rng):
    code = rng.choice([*P.MARKET_SIZES, 99])
    size = P.MARKET_SIZES.get(code, 11)
    body = bytearray(rng.randbytes(size - 8))
    if code in P.MARKET_BODY:
        layout = P.MARKET_BODY[code][0]
        values = [rng.uniform(0, 1e4) if c == "f" else rng.randrange(-(2**15), 2**15) for c in layout[1:]]
        body = struct.pack(layout, *values)
    return struct.pack("<BhBi", code, size, rng.randrange(12), rng.randrange(10**6)) + bytes(body)


def damaged(rng, frame):
    frame = bytearray(frame)
    what = rng.randrange(4)
    if what == 0:
        return bytes(frame[: rng.randrange(len(frame))])
    if what == 1:
        return bytes(frame) + rng.randbytes(rng.randrange(1, 12))
    if what == 2:
        frame[rng.randrange(3)] ^= 1 << rng.randrange(8)
    return bytes(frame)


@pytest.mark.parametrize("depth", [True, False])
def test_batches_read_as_single_frames_do(depth):
    rng = random.Random(6)
    one, read = (depth_packet, P.depth_packets) if depth else (market_packet, P.market_packets)
    frames = [b"".join(one(rng) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    frames = [damaged(rng, f) if k % 3 == 0 else f for k, f in enumerate(frames)] + [None, b""]
    table, errors = P.read_frames(pa.array(frames, pa.binary()), depth)
    rows = table.to_pylist()
    for k, frame in enumerate(frames):
        try:
            want, said = [] if frame is None else read(frame), None
        except ValueError as e:
            want, said = [], str(e)
        got = [tuple(dict(r[c]) if c == "fields" else r[c] for c in P.NAMES) for r in rows if r["frame"] == k]
        assert got == want and errors.get(k) == said
    assert len(errors) > 60


def test_frames_of_slices_and_of_nothing(spark):
    rng = random.Random(2)
    frames = pa.array([depth_packet(rng, 41) for _ in range(9)] + [b"x"], pa.binary())
    table, errors = P.read_frames(frames.slice(4), True)
    assert table.column("frame").to_pylist() == [0, 1, 2, 3, 4] and errors == {5: "cut short in a header"}
    none = spark.createDataFrame([], "id long, frame binary")
    assert P.decoded(none).count() == 0
    good, bad = P.decode(spark.createDataFrame([(1, None), (2, b""), (3, b"ab")], "id long, frame binary"))
    assert good.count() == 0 and [tuple(r) for r in bad.select("id", "error").collect()] == [(3, "cut short in a header")]


def test_packed_frames_read_back(spark):
    df = spark.range(300).selectExpr("id", "if(id % 2 = 0, 41, 51) AS code", "2 AS segment", "cast(id + 7 as int) AS security_id", "id AS sequence", "transform(sequence(1, 20), i -> id + i / 4) AS price", "transform(sequence(1, 20), i -> id * i) AS qty", "transform(sequence(1, 20), i -> i) AS orders")
    back = P.decoded(P.depth_frames(df).select("id", "frame"))
    want = df.selectExpr("id", "code", "cast(security_id as long) security_id", "sequence", "price", "qty", "cast(orders as array<bigint>) orders")
    assert sorted(map(tuple, back.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
