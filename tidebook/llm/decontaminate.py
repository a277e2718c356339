"""Benchmark decontamination by the q-gram lemma.

An item of m characters that lies in a document with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, all on diagonals (document position minus item
position) that differ by at most k. Shared q-grams are counted in bands of 2 (k + 1)
diagonals, each half overlapping the next, so every such set lies in one band; bands that
meet the bound are verified by an alignment that is confined to them.

q is 10, or less where an item's length and budget leave no q-gram unharmed otherwise. A document
place counts once in a band, however often its q-gram comes in the item, so rules of dashes
and other repetition cost a few bands for each place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, staged, texts_of
from .memo import release

Q = 10
#: Edits allowed, as a share of an item's characters.
EDITS = 0.08
#: Characters of items that are broadcast at once; a larger benchmark is searched in such blocks.
BLOCK_CHARS = 8_000_000
#: Places of bands that are counted at once, and cells of bands that are aligned at once.
HITS, CELLS = 2_000_000, 2_000_000
#: Pairs of text and item, and bands of diagonals, that one int64 key tells apart; the band of diagonal 0.
PAIRS, _BANDS, _ZERO = 1 << 30, 1 << 33, 1 << 32
SCHEMA = "doc_id long, item_id long, distance long, start long, end long, item_chars long"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"\s")


def normal(text: str) -> str:
    """Lower case and plain spaces; every character keeps its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low) if not low.isascii() else low.translate(_BLANK)


_BLANK = {i: " " for i in (*range(9, 14), *range(28, 32))}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(c) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, size, multiply = c.astype(np.uint64) + np.uint64(1), 1, int(_MULTIPLY)
    out, done = None, 0
    left = q
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(multiply) + part
            done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(multiply) + power[size:]
            size, multiply = size * 2, multiply * multiply % (1 << 64)
    out ^= out >> np.uint64(31)
    return out * _MULTIPLY


def gram_length(m: int, budget: int, q: int = Q) -> int:
    """The longest q-gram, up to q, of which an item of m characters keeps one at least after `budget` edits."""
    return min(q, m // (budget + 1))


class Grams:
    """The q-grams of items that have one q: by hash, the runs of places of each item.

    A run is places of one q-gram in one item whose neighbours are at most a band's step apart:
    for any document place it meets every band from that of its last place to that of its first.
    """

    def __init__(self, q: int, numbers: np.ndarray, items: list[np.ndarray], steps: np.ndarray):
        self.q = q
        grams = [qgrams(c, q) for c in items]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams)
        item = np.repeat(np.arange(len(items)), counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.lexsort((place, item, flat))
        flat, item, place = flat[order], item[order], place[order]
        begins = np.ones(len(flat), bool)
        begins[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > steps[item[1:]])
        at = np.flatnonzero(begins)
        self.item, self.low = numbers[item[at]].astype(np.int32), place[at].astype(np.int32)
        self.high = place[np.append(at[1:], len(flat)) - 1].astype(np.int32)
        self.hash, self.first, self.count = np.unique(flat[at], return_index=True, return_counts=True)
        bits = max(16, min(26, int(len(self.hash)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.hash >> self.shift).astype(np.int64)] = True

    def hits(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, number of its q-gram here) of the texts' q-grams that some item has."""
        grams = qgrams(flat, self.q)
        at = np.flatnonzero(self.maybe[(grams >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.hash, grams[at])
        k[k == len(self.hash)] = 0
        same = self.hash[k] == grams[at]
        at, k = at[same], k[same]
        text = np.searchsorted(starts, at, "right") - 1
        inner = at + self.q <= starts[text] + sizes[text]  # no q-gram across two texts
        at, k, text = at[inner], k[inner], text[inner]
        return text, at - starts[text], k


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of n values, in turn."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _slices(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose n add up to about `most` (one row at least)."""
    total, first = np.concatenate([[0], np.cumsum(n)]), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield slice(first, last)
        first = last


class Items:
    """A block of benchmark items; those without a character match nothing."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        rows = [(i, normal(t)) for i, t in rows if t]
        self.ids = [i for i, _ in rows]
        self.codes = [codes(t) for _, t in rows]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = (edits * self.size).astype(np.int64)
        q_of = np.array([gram_length(m, k, q) for m, k in zip(self.size.tolist(), self.budget.tolist())], np.int64)
        self.least = self.size - q_of + 1 - self.budget * q_of
        self.grams = []
        for n in np.unique(q_of).tolist():
            on = np.flatnonzero(q_of == n)
            self.grams.append(Grams(n, on, [self.codes[k] for k in on], self.budget[on] + 1))

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, first diagonal, last diagonal) of the bands that meet the bound, by text, item and diagonal."""
        if not self.grams:
            return []
        out = []
        most = max(1, PAIRS // len(self.ids))
        for first in range(0, len(texts), most):
            out += [(first + t, *rest) for t, *rest in self._candidates(texts[first : first + most])]
        return out

    def _candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(texts)
        out = []
        for grams in self.grams:
            keys, counts = self._counted(grams, *grams.hits(flat, starts, sizes))
            after = np.zeros(len(keys), np.int64)
            after[:-1] = np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
            pair = keys // _BANDS
            item = pair % len(self.ids)
            good = counts + after >= self.least[item]
            # An alignment may enter the half band below before its first unharmed q-gram.
            width = self.budget[item[good]] + 1
            low = (keys[good] % _BANDS - _ZERO - 1) * width
            out += zip((pair[good] // len(self.ids)).tolist(), item[good].tolist(), low.tolist(), (low + 3 * width - 1).tolist())
        return sorted(out)

    def _counted(self, grams: Grams, text: np.ndarray, place: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (text, item, half band), sorted, and how many places of the text meet each."""
        keys, counts, held = [], [], 0

        def add() -> None:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            keys[:], counts[:] = [key], [np.bincount(back, np.concatenate(counts)).astype(np.int64)]

        for rows in _slices(grams.count[k], HITS):
            n = grams.count[k[rows]]
            run = _ranges(grams.first[k[rows]], n)
            pair = np.repeat(text[rows], n) * len(self.ids) + grams.item[run]
            at, step = np.repeat(place[rows], n), self.budget[grams.item[run]] + 1
            first, last = np.floor_divide(at - grams.high[run], step), np.floor_divide(at - grams.low[run], step)
            for some in _slices(last - first + 1, HITS):
                bands = last[some] - first[some] + 1
                key, count = np.unique(np.repeat(pair[some], bands) * _BANDS + _ranges(first[some], bands) + _ZERO, return_counts=True)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held > 2 * HITS:
                    add()
                    held = len(keys[0])
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        add()
        return keys[0], counts[0]

    def align(self, texts: list[np.ndarray], found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """(distance, start, end) of the best alignment within each candidate's band.

        All candidates advance together by a character of their item; a cell holds the cost and,
        in its low bits, where the alignment began. Distances over the budget may be too high.
        """
        one = np.int64(1) << 32
        low = np.array([c[2] for c in found])
        item = np.array([c[1] for c in found])
        size = self.size[item]
        width = int((np.array([c[3] for c in found]) - low).max()) + 1
        longest = int(size.max())
        # Text characters by row and place within the band: cell (i, j) is document place low + i + j.
        span = longest + width
        window = np.full((len(found), span), 0xFFFFFFFF, np.uint32)
        pattern = np.full((len(found), longest), 0xFFFFFFFE, np.uint32)
        for k, (t, i, first, _) in enumerate(found):
            a, b = max(0, first), min(len(texts[t]), first + span)
            if a < b:
                window[k, a - first : b - first] = texts[t][a:b]
            pattern[k, : self.size[i]] = self.codes[i]
        j = np.arange(width, dtype=np.int64)
        # Before any item character: the alignment may begin at any place of the band, at no cost.
        cost = np.broadcast_to(j, (len(found), width)).copy()
        outside = low[:, None] + j < 0
        cost[outside] += one * 100_000
        best = np.zeros(len(found), np.int64)
        ends = np.zeros(len(found), np.int64)
        for i in range(longest):
            diagonal = cost + np.where(window[:, i : i + width] == pattern[:, i : i + 1], 0, one)
            diagonal[:, :-1] = np.minimum(diagonal[:, :-1], cost[:, 1:] + one)  # item character left out
            cost = np.minimum.accumulate(diagonal - j * one, axis=1) + j * one  # extra document characters
            done = np.flatnonzero(size == i + 1)
            if len(done):
                at = cost[done].argmin(axis=1)
                best[done] = cost[done, at]
                ends[done] = low[done] + i + 1 + at
        starts = low + (best & (one - 1))
        return list(zip((best >> 32).tolist(), starts.tolist(), ends.tolist()))

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each text and item within its budget, the best place only.

        Bands of items of like size are aligned together, so many at once as make about CELLS cells. A
        text's bands come in order, so where an item was found unchanged its later bands can't be better.
        """
        arrays = [codes(normal(t)) for t in texts]
        found = self.candidates(arrays)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not found:
            return []
        item = np.array([c[1] for c in found])
        size, width = self.size[item], 3 * self.budget[item] + 3
        order = np.argsort(size, kind="stable")
        cells = (size + 6 * width)[order]  # grows with the size
        first = 0
        while first < len(order):
            last = min(len(order), first + max(1, CELLS // int(cells[first])))
            last = min(last, first + max(1, CELLS // int(cells[last - 1])))
            part = [found[k] for k in order[first:last].tolist()]
            part = [c for c in part if best.get(c[:2], (1,))[0]]
            for (t, i, _, _), (distance, start, end) in zip(part, self.align(arrays, part) if part else ()):
                if distance <= self.budget[i] and (distance, start, end) < best.get((t, i), (1 << 30, 0, 0)):
                    best[t, i] = (distance, start, end)
            first = last
        return sorted((t, i, *b) for (t, i), b in best.items())


def blocks(benchmark: DataFrame, q: int, edits: float, text_col: str, id_col: str, block_chars: int) -> Iterator:
    """Broadcasts of Items, one for each block of the benchmark of at most about `block_chars` characters."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        items = Items([(r[0], r[1]) for r in part.collect()], q, edits)
        yield benchmark.sparkSession.sparkContext.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item that it holds with at most `edits` x its characters edits.

    Columns: doc_id, item_id, distance, start, end (code points, end exclusive), item_chars. Case
    and kinds of white space don't count. The budget is rounded down for items of all lengths, so by
    default those of up to 12 characters are found only unchanged; a null or empty item matches
    nothing, and null and empty texts hold nothing. Of several places the one with the fewest edits is
    given, then the first. Repeated rows give rows each; null ids stay null; other columns are not
    read; an empty table on either side gives no rows. Work on a text grows with its length times the
    items that share its q-grams; verifying an item costs its length times its budget for each
    band that meets the bound. No shuffle; a benchmark of several blocks is searched block by block.
    """
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in blocks(benchmark, q, edits, item_text_col, item_id_col, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            items = shared.value
            for batch in pieces(batches, "text", 4 << 20):
                keys = batch.column("doc_id").to_pylist()
                rows = [(keys[t], items.ids[i], d, s, e, int(items.size[i])) for t, i, d, s, e in items.search(texts_of(batch, "text"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        part = lean.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _without(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches, "text", 4 << 20):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in shared.value.search(texts_of(batch, "text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _with(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches, "text", 4 << 20):
            found = sorted({t for t, *_ in shared.value.search(texts_of(batch, "text"))})
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(found, pa.int64()))], names=["h"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those whose `text` holds a benchmark item, as `contaminated` finds it; all columns stay.

    Null and empty texts stay. The verdict depends on a row's text alone, so repeated rows, ties
    and null ids are safe, and columns of any other name pass through. An empty table gives an empty
    one; an empty benchmark leaves all rows. A very long text is searched whole by one task, in some 50 bytes a byte. Rows are filtered where they lie. Only if the benchmark
    has several blocks are they joined instead with the keys of the texts that hold an item, so
    that no worker holds more than one block.
    """
    made = list(blocks(benchmark, q, edits, "text", "item_id", block_chars))
    if len(made) == 1:
        return docs.mapInArrow(_without(made[0]), docs.schema)
    text = F.col("text").cast("string")
    key = F.unhex(F.md5(text.cast("binary")))
    lean = docs.filter(F.length(text) > 0).select(key.alias("h"), text.alias("text"))
    found = [lean.mapInArrow(_with(shared), "h binary") for shared in made]
    every = found[0]
    for other in found[1:]:
        every = every.unionAll(other)
    name = f"_h_{uuid.uuid4().hex}"  # a name that docs can't have
    gone = staged(every.distinct(), "contaminated").withColumnRenamed("h", name)
    return docs.join(gone, key == F.col(name), "left_anti")
