"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each bit that is set in over half of its shingles' hashes.
Fingerprints within RADIUS bits of each other are linked. Rows with the same fingerprint take part once.

Of the 64 bits cut into RADIUS + k parts, two linked fingerprints agree in k parts at least. Each choice
of k parts deals the fingerprints out by those bits, so each link meets somewhere, whatever
the bits are. There, fingerprints are ordered by population count and tiles of equal population count
are compared by exclusive or and bit counts, leaving out pairs of tiles whose counts differ by more than the
radius. Where many fingerprints agree in such bits, their tiles are dealt out pair by pair to tasks, again
without the pairs that are too far apart. A task returns each member with the least one that it is
connected with there, never pairs; components are then contracted over these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, salted_join, slices, staged, utf8
from .jaccard import _runs, _starts, components

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a tile; a bucket of more is compared by several tasks.
TILE = 2048
_PAIRS_AT_ONCE = 500_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _counted(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        out += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    for part in slices(text.lower(), _SPACE):
        held += part.split()
        if len(held) < words:
            continue
        joined = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)
        counts += _counted(hashes)
        total += len(hashes)
        held = held[len(held) - words + 1 :]
    if not total:
        return digest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        found = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def parts_for(fingerprints: int, radius: int = RADIUS, tile: int = TILE) -> int:
    """Into how many parts 64 bits are cut, so that on the mean a tile's worth of fingerprints agrees in a choice."""
    parts = radius + 1
    while parts < radius + 4 and fingerprints >> (64 * (parts - radius) // parts) > tile // 2:
        parts += 1
    return parts


def masks(parts: int, radius: int = RADIUS) -> list[int]:
    """Signed masks of the bits in which two fingerprints within the radius agree, for one of them at least."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    found = [sum(c) for c in combinations(bits, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each component) after the links (a, b) are added."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


TILES = ("mask", "key", "i", "j")


def _compare(radius: int):
    """Members of each pair of tiles with the least member that they are connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TILES, 5000):
            starts = _starts(t, TILES)
            fp, block, i, j = (t.column(c).to_numpy() for c in ("fp", "block", "i", "j"))
            bits = fp.view(np.uint64)
            # Rows come by pair of tiles and by population count: those within the radius are neighbours.
            place = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * 256 + np.bitwise_count(bits)
            after = np.searchsorted(place, place + radius, "right") - np.arange(len(fp)) - 1
            total = np.concatenate([[0], np.cumsum(after)])
            label, first = np.arange(len(fp)), 0
            while first < len(fp):
                last = max(first + 1, int(np.searchsorted(total, total[first] + _PAIRS_AT_ONCE, "right")) - 1)
                n = after[first:last]
                a = np.repeat(np.arange(first, last), n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                near = (np.bitwise_count(bits[a] ^ bits[b]) <= radius) & ((i[a] == j[a]) | (block[a] != block[b]))
                label = merged(label, a[near], b[near])
                first = last
            on = np.flatnonzero(label != np.arange(len(fp)))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(fp[on]), pa.array(fp[label[on]])], names=["a", "b"])

    return run


def near_fingerprints(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """(a, b) over distinct fp: rows whose components are those of all fingerprints linked within the radius."""
    chosen = masks(parts or parts_for(fingerprints.count(), radius, tile), radius)
    dealt = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(chosen))))
    rows = fingerprints.select("fp", F.bit_count("fp").alias("ones"), dealt.alias("at")).select("fp", "ones", "at.mask", "at.key")
    # A bucket's tiles: how many there are of each population count (65 at most), once one is not enough.
    counted = rows.groupBy("mask", "key", "ones").agg(F.count("*").alias("n"))
    tiles = F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    buckets = counted.groupBy("mask", "key").agg(F.sum("n").alias("n"), tiles.alias("tiles")).filter("n > 1")
    buckets = buckets.select("mask", "key", F.when(F.col("n") > tile, F.col("tiles")).alias("tiles"), F.struct("mask", "key").alias("bucket"))
    met = salted_join(rows.withColumn("bucket", F.struct("mask", "key")).drop("mask", "key"), buckets, "bucket")
    number = lambda ones, part: F.shiftleft(ones.cast("long"), 40) + part
    own = F.expr("filter(tiles, t -> t.ones = ones)[0].tiles")
    met = met.withColumn("block", F.when(F.col("tiles").isNull(), 0).otherwise(number(F.col("ones"), F.pmod(F.xxhash64("fp"), own))))
    others = F.expr(f"flatten(transform(filter(tiles, t -> abs(t.ones - ones) <= {radius}), t -> transform(sequence(0, t.tiles - 1), k -> shiftleft(bigint(t.ones), 40) + k)))")
    met = met.select("mask", "key", "fp", "ones", "block", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("other"))
    pairs = met.select("mask", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "ones", "fp", "block")
    found = pairs.repartition(*TILES).sortWithinPartitions(*TILES, "ones").drop("ones")
    return found.mapInArrow(_compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id, n_same.

    component_id is the smallest doc_id that links lead to, itself included; n_same counts the rows with the
    very fingerprint. Words are what ASCII white space separates, A-Z lower-cased; a text of one or two words is
    one shingle; one without words, null ones among them, has fingerprint zero, which links like any other.
    A null id names a component only where it has no other. Repeated rows share a fingerprint;
    very long texts are read in slices; other columns are not read; an empty table gives no rows.
    """
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(lean.mapInArrow(_sign, "doc_id long, fp long"), "fingerprints")
    classes = staged(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")), "distinct")
    label = components(near_fingerprints(classes.select("fp"), radius, tile, parts)).withColumnRenamed("node", "fp")
    named = staged(classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    out = salted_join(signed, named.join(least, "label").select("fp", "component_id", "n_same"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
