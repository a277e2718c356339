"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked when their Jaccard similarity is at
least 0.8. Equal texts form a class, and only one text of a class takes part. Classes that
agree on a band of MinHash values are compared, value by value in steps: under a uniform
prior, pairs whose posterior probability of reaching the threshold falls below a tolerance are
dropped, and the rest is verified exactly on the shingles.

A pair is looked at in the first band that it shares, so links are counted once. Buckets of a
band are cut into blocks, bounded in texts and in bytes; a tile is two blocks. A first pass over
signatures tells which members of a tile have a partner there; only these come again with their
texts, and the tile prunes once more and verifies. Either pass returns a row per member (in the
end how many links it has there, and a representative of its component there), never pairs. A
member of a bucket of n texts comes to n / TILE tiles. Components are then contracted over those
representatives.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, salted_join, staged, texts_of
from .memo import Numbers, grown, kept

WORDS, THRESHOLD = 5, 0.8
#: One byte of each MinHash value is kept; BANDS of ROWS values make candidates. A pair at the
#: threshold shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
ROWS, BANDS = 4, 32
VALUES = ROWS * BANDS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a block, and their bytes: a tile compares the members of two blocks.
TILE, TILE_BYTES = 512, 6 << 20
_PAIRS_AT_ONCE = 100_000

_RNG = np.random.default_rng(20)
_FACTOR = (_RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64) | 1).astype(np.uint32)
_SHIFT = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15


class WordHashes:
    """64-bit hashes of the words of texts, remembered across texts."""

    def __init__(self) -> None:
        self.numbers = Numbers(lambda t: t.encode("utf-8", "surrogatepass").split(), self._learn, most=200_000)
        self.table = np.zeros(1 << 16, np.uint64)

    def _learn(self, words: list[bytes], first: int) -> None:
        import xxhash

        self.table = grown(self.table, first + len(words))
        self.table[first : first + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        at, sizes = self.numbers.batch(texts)
        return np.split(self.table[at], np.cumsum(sizes)[:-1])


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(sh: np.ndarray) -> bytes:
    """A byte of each MinHash value."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (np.multiply.outer(_FACTOR, x[i : i + 1024]) + _SHIFT[:, None]).min(axis=1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[int]:
    """After step, 2 step, ... values: the fewest equal ones with which a pair goes on.

    A byte is equal with probability s + (1 - s) / 256 at similarity s; s is uniform beforehand.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(step, VALUES + 1, step):
        need = n + 1
        for m in range(n, -1, -1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() < tolerance:
                break
            need = m
        out.append(need)
    return out


def _surviving(sig: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int], step: int) -> np.ndarray:
    """Which of the pairs (a, b) of rows first meet in this band and pass every step."""
    x, y = sig[a], sig[b]
    same = x.view(np.uint32) == y.view(np.uint32)
    on = np.flatnonzero(same.argmax(axis=1) == band[a])
    equal = np.zeros(len(on), np.int64)
    for k, need in enumerate(least):
        part = slice(k * step, (k + 1) * step)
        equal += (x[on, part] == y[on, part]).sum(axis=1)
        good = equal >= need
        on, equal = on[good], equal[good]
    return on


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys; as many runs as make `least` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        keys = [t.column(n).to_numpy() for n in names]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(change):
            yield t.slice(0, change[-1] + 1)
            held = t.slice(change[-1] + 1).to_batches()
            rows = t.num_rows - int(change[-1]) - 1
    if held:
        yield pa.Table.from_batches(held)


def _starts(t: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    keys = [t.column(n).to_numpy() for n in names]
    return np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, [t.num_rows]])


TILE_KEYS = ("key", "i", "j")


def _survivors(t: pa.Table, starts: np.ndarray, least: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same tile that first meet in the tile's band and pass every step."""
    band, block, i, j = (t.column(c).to_numpy() for c in ("band", "block", "i", "j"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
    rows = t.num_rows
    after = np.repeat(starts[1:], np.diff(starts)) - np.arange(rows) - 1  # rows of the same tile that follow
    total = np.concatenate([[0], np.cumsum(after)])
    first, found_a, found_b = 0, [], []
    while first < rows:
        last = max(first + 1, int(np.searchsorted(total, total[first] + _PAIRS_AT_ONCE, "right")) - 1)
        n = after[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        apart = (i[a] == j[a]) | (block[a] != block[b])
        a, b = a[apart], b[apart]
        if len(a):
            on = _surviving(sig, band, a, b, least, step)
            found_a.append(a[on])
            found_b.append(b[on])
        first = last
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))


def _prune(least: list[int], step: int):
    """Of each tile the members that have a partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, TILE_KEYS, 5000):
            a, b = _survivors(t, _starts(t, TILE_KEYS), least, step)
            if len(a):
                yield from t.drop_columns(["sig"]).take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    return run


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets a[k] and b[k] share: pair by pair, or many pairs by a product."""
    if len(a) <= 4 * len(sets):
        out = np.empty(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            u, v = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            out[k] = (v[at] == u).sum()
        return out
    sizes = np.array([len(s) for s in sets])
    distinct, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, at = row[shared[at]], number[at[shared[at]]]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(shared.sum()), 4096):
        p, q = np.searchsorted(at, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[p:q], at[p:q] - low] = 1
        counts += part @ part.T
    return counts[a, b].astype(np.int64)


def _roots(n: int, a: list[int], b: list[int]) -> list[int]:
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


LINKS = "uid long, links long, linked_docs long, root long"


def _verify(threshold: float, words: int, least: list[int], step: int):
    """Exact links within each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", "jaccard", WordHashes)
        for t in _runs(batches, TILE_KEYS, 500):
            starts = _starts(t, TILE_KEYS)
            a, b = _survivors(t, starts, least, step)
            uids, docs = t.column("uid").to_numpy(), t.column("size").to_numpy()
            cut = np.searchsorted(a, starts)  # pairs come in order of their first row, so tile by tile
            out: list[tuple] = []
            for s, e, p, q in zip(starts[:-1].tolist(), starts[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                if p == q:
                    continue
                texts = [x or "" for x in t.column("text").slice(s, e - s).to_pylist()]
                sets = [shingles(w, words) for w in hashes.batch(texts)]
                x, y = a[p:q] - s, b[p:q] - s
                size = np.array([len(v) for v in sets])
                both = common_counts(sets, x, y)
                linked = both >= threshold * (size[x] + size[y] - both) - 1e-9
                x, y = x[linked], y[linked]
                if not len(x):
                    continue
                n, weight, uid = len(sets), docs[s:e], uids[s:e]
                links = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
                linked_docs = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
                root = _roots(n, x.tolist(), y.tolist())
                out += [(int(uid[k]), int(links[k]), int(linked_docs[k]), int(uid[root[k]])) for k in np.flatnonzero(links).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["uid", "links", "linked_docs", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges(a, b): equal labels mark one connected component.

    Each round maps a node to the least of itself and its neighbours, in an order drawn anew each
    round, and goes on with the edges between the nodes mapped to; rounds grow as the logarithm
    of the longest path. Nodes and edges stay in tables.
    """
    steps: list[DataFrame] = []
    edges = staged(edges.filter("a <> b").distinct(), "edges")
    first = edges
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("rank"), F.col(c).alias("node"))  # noqa: E731, B023
        ways = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = ways.groupBy("a").agg(F.min(rank("b")).alias("near")).select("a", F.least(rank("a"), F.col("near")).getField("node").alias("to"))
        nearest = staged(nearest, "nearest")
        steps.append(nearest)
        moved = edges.join(nearest.withColumnRenamed("to", "x"), "a").select("b", "x")
        moved = moved.join(nearest.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = staged(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return first.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = steps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for step in steps[1:]:
        label = label.join(step.withColumnsRenamed({"a": "label", "to": "next"}), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return staged(label, "labels")


def _text_key(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def repeats(members: DataFrame) -> bool:
    """Whether a row occurs again with its id and text."""
    return not members.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()


def linked_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members, classes).

    members: doc_id and h (the key of its text) of every row. classes: h, first_id (its smallest
    id), size (rows), links (other classes linked to it), linked_docs (their rows) and label
    (equal within a component).
    """
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("words", "jaccard", WordHashes)
        for batch in pieces(batches, "text", 4 << 20):
            sets = [shingles(w, words) for w in hashes.batch(texts_of(batch, "text"))]
            sig = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
            bytes_ = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), sig, bytes_], names=["doc_id", "h", "sig", "bytes"])

    signed = staged(lean.mapInArrow(sign, "doc_id long, h binary, sig binary, bytes long"), "signed")
    grouped = signed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    classes = staged(grouped.withColumn("uid", F.monotonically_increasing_id()), "classes")

    whole = classes.filter("sig IS NOT NULL").select("uid", "sig", "bytes")
    codes = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> named_struct('band', k, 'key', xxhash64(k, substring(sig, {ROWS} * k + 1, {ROWS}))))")
    bands = whole.select("uid", "bytes", F.inline(codes))
    full = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).filter("n > 1")
    full = full.select("key", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("total") / tile_bytes)).cast("int").alias("blocks"))
    met = salted_join(bands.drop("bytes"), full, "key").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    rows = met.join(whole.select("uid", "sig"), "uid").select("key", "band", "uid", "sig", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "uid", "sig", "block")
    least = least_matches(threshold, tolerance)
    pruned = rows.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS).mapInArrow(_prune(least, STEP), "key long, i int, j int, band int, uid long, block int")
    pruned = staged(pruned, "pruned")

    named = classes.select("uid", "h", "size", "first_id")
    needed = pruned.select("uid").distinct().join(classes.select("uid", "h", "size", "first_id", "sig"), "uid")
    # One text of each class: that of its smallest id; of rows repeated with their id, one.
    texts = lean.join(needed.withColumnRenamed("h", "class_h"), (F.col("h") == F.col("class_h")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    if repeats(signed):
        texts = texts.dropDuplicates(["uid"])
    tiles = pruned.join(texts.select("uid", "size", "sig", "text"), "uid").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
    verified = staged(tiles.mapInArrow(_verify(threshold, words, least, STEP), LINKS), "links")

    label = components(verified.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "uid"})
    counts = verified.groupBy("uid").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    out = named.join(counts, "uid", "left").join(label, "uid", "left")
    out = out.select("h", "first_id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"), F.coalesce("label", "uid").alias("label"))
    return signed.select("doc_id", "h", F.col("sig").isNull().alias("empty")), staged(out, "linked")


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, class_id, n_links and n_copies.

    class_id is the smallest doc_id of its connected component, n_links counts the other documents
    whose similarity to it is at least the threshold (its copies among them), n_copies the rows
    with its very text. Words are what ASCII white space separates; a text of one to four words
    is one shingle. Texts without a word, null ones among them, link to nothing: their class is
    their own id and they have no copies but themselves. A null id doesn't name a class while
    another id does. Repeated rows are copies of one another; other columns are not read; an empty
    table gives no rows. Pairs that tie at the threshold are linked. A very long text is shingled whole by one task,
    and compared in tiles of its own where it passes TILE_BYTES.
    """
    members, classes = linked_classes(docs, **settings)
    names = classes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = classes.join(names, "label").select("h", "class_id", "size", "linked_docs")
    out = salted_join(members, named, "h")
    alone = F.col("empty")
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("linked_docs") + F.col("size") - 1).alias("n_links"),
        F.when(alone, 1).otherwise(F.col("size")).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each component: that of the smallest id.

    Null, empty and blank texts stay. Of rows repeated with id and text one stays, of texts that tie for the smallest id that
    with the least key; a null id stays only if its component has no other. Columns of any other name pass through; an empty table gives an
    empty one. Very long texts are compared as jaccard_join does.
    """
    members, classes = linked_classes(docs, **settings)
    first = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "h")
    best = classes.groupBy("label").agg(F.min(first).alias("best"))
    stays = classes.join(best, "label").select("h", (F.col("h") == F.col("best.h")).alias("this"), "first_id")
    # Keys of rows that go: of another class, or of the class but with another id.
    h, gone_h, gone_id = (f"_{c}_{uuid.uuid4().hex}" for c in ("h", "gone_h", "gone_id"))  # names that docs can't have
    rows = salted_join(members.filter(~F.col("empty")), stays, "h")
    gone = rows.filter(~(F.col("this") & F.col("doc_id").eqNullSafe(F.col("first_id")))).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    marked = docs.withColumn(h, _text_key("text"))
    left = marked.join(gone, (F.col(h) == F.col(gone_h)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    if repeats(members.filter(~F.col("empty"))):
        worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        left = left.filter(worded).dropDuplicates(["doc_id", h]).unionByName(left.filter(~worded))
    return left.drop(h)
