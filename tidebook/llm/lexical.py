"""Ranked lexical search with a bit-sliced impact index.

Documents are held in segments. In a segment a term has the places of the documents that hold it and,
slice by slice, the bits of its impact on each of them: what the term adds to the score of a
document that is asked for it. A search adds the slices of a query's terms as whole bitmaps, by bitwise
carry arithmetic, and finds the best documents from the most significant slice down; no document's score
is worked out but those of the documents found. Segments are searched side by side, and the best of the
segments' best are the answer.

Impacts are exact integers, so scores are those of the definition:
w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, impact = w * (10 ** 9 tf div (1000 tf + 20 m)).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, slices, staged, utf8

#: Documents (65,536 at most, as places are 16-bit numbers) and postings of a segment; the document that passes POSTINGS is its last.
DOCUMENTS, POSTINGS = 16_384, 2_000_000
#: Queries that a task adds up side by side, and documents told of each.
QUERIES_AT_ONCE, TOP = 128, 50

#: Letters of a term: all that is not ASCII, and ASCII letters and digits; A-Z are lower-cased.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in their order, some at a time."""
    for part in slices(text, _BREAK):
        yield part.translate(_LETTERS).split()


SEGMENTS = "segment long, term string, df long, n_docs long, n_terms long, docs binary, tf binary, ids binary"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes cut at row ends, as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column in turn, and how many each row has."""
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join([x or b"" for x in column.to_pylist()]), kind), sizes // np.dtype(kind).itemsize


def _counts(tf: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Counts cut at row ends, a byte each in rows where all are below 256, else four."""
    rows = np.diff(ends)
    wide = np.maximum.reduceat(tf, ends[:-1]) > 255
    keep = np.ones((len(tf), 4), bool)
    keep[:, 1:] = np.repeat(wide, rows)[:, None]
    data = np.ascontiguousarray(tf.astype("<u4")).view(np.uint8).reshape(-1, 4)[keep]
    return _binary(data, np.concatenate([[0], np.cumsum(rows * np.where(wide, 4, 1))]))


def _flat_counts(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """What _counts has packed, for rows of so many counts."""
    held = column.to_pylist()
    wide = np.fromiter(map(len, held), np.int64, len(held)) > rows
    out, at = np.empty(int(rows.sum()), np.int64), np.repeat(wide, rows)
    out[~at] = np.frombuffer(b"".join([x for x, w in zip(held, wide.tolist()) if not w]), np.uint8)
    out[at] = np.frombuffer(b"".join([x for x, w in zip(held, wide.tolist()) if w]), "<u4")
    return out


class _Segment:
    def __init__(self, number: int):
        self.number, self.at = number, {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        at, size, parts = self.at, 0, []
        for words in terms_of(text):
            size += len(words)
            parts.append(np.unique(np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words)), return_counts=True))
        if len(parts) > 1:
            term, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            parts = [(term, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.found.append(parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        self.postings += len(self.found[-1][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """First a row without a term: ids and sizes of the documents by ascending id; then a row per term."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        sizes = np.array(self.sizes, np.int64)[order]
        ids = np.array([-1 if self.ids[k] is None else self.ids[k] for k in order], np.int64)
        known = np.array([self.ids[k] is not None for k in order], np.int64)
        whole = np.concatenate([ids, known, sizes])
        one = lambda n: np.array([n], np.int64)
        none = pa.nulls(1, pa.binary())
        yield self._batch([None], one(0), none, none, pa.array([whole.tobytes()], pa.binary()), int((sizes > 0).sum()), int(sizes.sum()))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = np.concatenate([f[0] for f in self.found])
        tf = np.concatenate([f[1] for f in self.found])
        doc = np.repeat(place, [len(f[0]) for f in self.found])
        by = np.lexsort((doc, term))
        doc, tf = doc[by].astype(np.uint16), tf[by]
        cut = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.at)))])
        words = list(self.at)
        for k in range(0, len(words), 50_000):
            ends = cut[k : k + 50_001]
            part = slice(ends[0], ends[-1])
            held = words[k : k + 50_000]
            yield self._batch(held, np.diff(ends), _binary(doc[part], 2 * (ends - ends[0])), _counts(tf[part], ends - ends[0]), pa.nulls(len(held), pa.binary()))

    def _batch(self, terms: list, df: np.ndarray, docs: pa.Array, tf: pa.Array, ids: pa.Array, n_docs: int = 0, n_terms: int = 0) -> pa.RecordBatch:
        every = lambda n: pa.array(np.full(len(terms), n, np.int64))
        made = [every(self.number), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(df), every(n_docs), every(n_terms), docs, tf, ids]
        return pa.RecordBatch.from_arrays(made, names=["segment", "term", "df", "n_docs", "n_terms", "docs", "tf", "ids"])


def _segments(documents: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = _Segment(number)
        for batch in pieces(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                held.add(doc_id, text)
                if len(held.ids) >= documents or held.postings >= postings:
                    yield from held.rows()
                    number += 1
                    held = _Segment(number)
        if held.ids:
            yield from held.rows()

    return run


def sliced(impact: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bits of impacts, `rows` of them a term: per term slice after slice (a bit of each impact, least significant
    first) as one string of bits, and how many slices there are."""
    starts = np.cumsum(rows) - rows
    most = np.maximum.reduceat(impact, starts) if len(rows) else rows
    bits = np.maximum(np.frexp(most.astype(float))[1], 1).astype(np.int64)
    bytes_ = (bits * rows + 7) // 8
    ends = np.concatenate([[0], np.cumsum(bytes_)])
    row = np.repeat(np.arange(len(rows)), rows)
    n, deep = rows[row], bits[row]
    at = 8 * ends[:-1][row] + np.arange(len(impact)) - starts[row]
    out = np.zeros(8 * ends[-1], np.uint8)
    for b in range(int(bits.max(initial=0))):
        has = deep > b
        out[at[has] + b * n[has]] = impact[has] >> b & 1
    return _binary(np.packbits(out, bitorder="little"), ends), bits


def _impacts(n_docs: int, n_terms: int):
    """Segments' rows, each segment's documents first, to rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            firsts = [k for k, x in enumerate(ids) if x is not None]
            for s, e in zip([0, *firsts], [*firsts, batch.num_rows]):
                part = batch.slice(s, e - s)
                if not part.num_rows:
                    continue
                if ids[s] is not None:
                    sizes = np.frombuffer(ids[s], np.int64).reshape(3, -1)[2].tolist()
                    mean = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in sizes], np.int64)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(0, 1) for c in ("segment", "term", "docs")), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), part.column("ids").slice(0, 1)], names=INDEX_NAMES)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                docs, rows = _flat(part.column("docs"), np.uint16)
                tf = _flat_counts(part.column("tf"), rows)
                impact = np.repeat(part.column("weight").to_numpy(), rows) * (1_000_000_000 * tf // (1000 * tf + 20 * mean[docs]))
                held, bits = sliced(impact, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("segment", "term", "docs")), pa.array(bits), held, part.column("ids")], names=INDEX_NAMES)

    return run


INDEX = "segment long, term string, docs binary, bits long, slices binary, ids binary"
INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def impact_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", documents: int = DOCUMENTS, postings: int = POSTINGS) -> DataFrame:
    """The index of all terms of all documents: a row per segment and term, and one per segment (term null) with its documents.

    The terms' frequencies come from all segments by one aggregation; a term's rows, one a segment, meet its weight
    in a join whose large partitions adaptive execution splits.
    """
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = staged(lean.mapInArrow(_segments(documents, postings), SEGMENTS), "segments", "zstd")
    n_docs, n_terms = held.filter("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    frequent = held.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("all_df") + 1).cast("double")))
    names = ["segment", "term", "docs", "tf", "ids", "weight"]
    weighed = held.filter("term IS NOT NULL").join(frequent.select("term", weight.alias("weight")), "term").select(names)
    rows = weighed.unionByName(held.filter("term IS NULL").withColumn("weight", F.lit(0).cast("long")).select(names)).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("term"))
    return staged(rows.mapInArrow(_impacts(n_docs, n_terms), INDEX), "impacts", "zstd")


def add_slices(total: list[np.ndarray], more: np.ndarray) -> None:
    """Add numbers given as slices to others, in place: a bitwise full adder over whole bitmaps."""
    carry: np.ndarray | None = None
    for k in range(max(len(total), len(more))):
        if k >= len(more) and carry is None:
            return
        if k == len(total):
            total.append(np.zeros_like(more[0]))
        a = total[k]
        if k >= len(more):
            total[k], carry = a ^ carry, a & carry
        elif carry is None:
            total[k], carry = a ^ more[k], a & more[k]
        else:
            both = a ^ more[k]
            total[k], carry = both ^ carry, (a & more[k]) | (both & carry)
        if carry is not None and not carry.any():
            carry = None
    if carry is not None:
        total.append(carry)


def best(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k largest numbers above 0 (of equal ones the first places), by place."""
    some = np.bitwise_or.reduce(total)
    above, equal = np.zeros_like(some), some
    for s in reversed(total):
        if int(np.bitwise_count(above).sum()) + int(np.bitwise_count(equal).sum()) <= k:
            break
        found = equal & s
        n = int(np.bitwise_count(above).sum()) + int(np.bitwise_count(found).sum())
        if n > k:
            equal = found
        else:
            above = above | found
            equal = equal & ~s
    places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    at = places(above)
    at = np.sort(np.concatenate([at, places(equal)[: max(0, k - len(at))]]))
    score = np.zeros(len(at), np.int64)
    for b, s in enumerate(total):
        score |= ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    return at, score


def bitmaps(docs: bytes, bits: int, slices_: bytes, words: int) -> np.ndarray:
    """A term's slices as bitmaps over all documents of the segment."""
    at = np.frombuffer(docs, np.uint16)
    held = np.unpackbits(np.frombuffer(slices_, np.uint8), bitorder="little", count=bits * len(at)).reshape(bits, -1)
    out = np.zeros((bits, words * 64), np.uint8)
    out[:, at] = held
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _search(top: int):
    """Rows of (segment, block of queries), documents first, to the best documents of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids = known = np.zeros(0, np.int64)
        words, totals = 0, {}

        def out() -> Iterator[pa.RecordBatch]:
            query, doc, score = [], [], []
            for q, total in totals.items():
                at, s = best(total, top)
                query += [q] * len(at)
                doc += [i if k else None for i, k in zip(ids[at].tolist(), known[at].tolist())]
                score += s.tolist()
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

        for batch in batches:
            for segment, block, term, docs, bits, held, whole, asked in zip(*(batch.column(c).to_pylist() for c in ("segment", "block", "term", "docs", "bits", "slices", "ids", "queries"))):
                if (segment, block) != now:
                    yield from out()
                    now, totals = (segment, block), {}
                if term is None:
                    ids, known = np.frombuffer(whole, np.int64).reshape(3, -1)[:2]
                    words = max(1, (len(ids) + 63) // 64)
                    continue
                more = bitmaps(docs, bits, held, words)
                for q in asked:
                    add_slices(totals.setdefault(q, []), more)
        yield from out()

    return run


def _asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 20):
        query, term = [], []
        for q, text in zip(batch.column("query").to_pylist(), utf8(batch.column("text"))):
            own = {w for words in terms_of(text) for w in words}
            query += [q] * len(own)
            term += [w.decode("utf-8", "replace") for w in own]
        if query:
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(term, pa.string())], names=["query", "term"])


def ranked_search(index: DataFrame, queries: DataFrame, text_col: str = "text", id_col: str = "item_id", top: int = TOP, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(id_col, rank, doc_id, score): each query's `top` documents of the index with scores above 0.

    Equal scores rank by ascending doc_id, null ids last; the same document twice in the table ranks twice, and so
    does a repeated query row (its ranks go on). A null, empty or blank query, or one whose terms no document has, gives no rows.
    """
    asked = staged(queries.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).orderBy("item", "text").withColumn("query", F.monotonically_increasing_id()), "queries")
    held = asked.filter("text IS NOT NULL").select("query", "text").mapInArrow(_asked_terms, "query long, term string")
    blocks = max(1, -(-asked.count() // at_once))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    terms = held.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list("query")).alias("queries"))
    terms = terms.groupBy("term").agg(F.collect_list(F.struct("block", "queries")).alias("asked"))
    names = ["segment", "term", "docs", "bits", "slices", "ids"]
    rows = index.filter("term IS NOT NULL").select(names).join(terms, "term").withColumn("asked", F.explode("asked"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    documents = index.filter("term IS NULL").select(*names, every.alias("block"), F.lit(None).cast("array<bigint>").alias("queries"))
    both = rows.select(*names, "asked.block", "asked.queries").unionByName(documents)
    both = both.repartition("segment", "block").sortWithinPartitions("segment", "block", F.asc_nulls_first("term"))
    found = both.mapInArrow(_search(top), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item"), "query").select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, **settings) -> DataFrame:
    """ranked_search over an index of docs(doc_id, text).

    Null, empty and blank texts have no terms and are never found; repeated rows are documents of their own; very long
    texts are read in slices; other columns are not read; an empty table gives no rows.
    """
    return ranked_search(impact_index(docs), queries, **settings)
