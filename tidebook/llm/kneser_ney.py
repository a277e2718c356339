"""Language model scoring: an interpolated modified Kneser-Ney model of word pairs, or of triples.

Counting n-grams is two shuffles. Tasks count the n-grams of their documents and send them, as arrays,
to shards by the word before the last. So a shard has all n-grams of a context (what comes before the
last word) and all n-grams that end alike: it adds them up, and tells for each pair after how
many different words it comes, which is the pair's count in the model of lower order. n-grams and
pairs are written as sorted hash arrays with counts, contexts with what is known of their followers.
What a shard knows of single words - with how many followers they come, and after how many different
words - goes to word shards, which write sorted hash arrays as well. Workers map those files into
memory to score texts.

n-grams around very frequent words are spread over all shards by what comes before; their pairs
are added up in the word shards. A pass over all texts, before, counts their tokens and words for that.

A context is known if its last two words are a known pair. Those that were followed once in all,
which are most, are not written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, new_dir, pieces, texts_of
from .memo import Numbers, grown, kept

#: Words of an n-gram: 2, or 3. Triples take more disk than the check tool allows (README).
ORDER = 2
#: Tokens whose n-grams a task gathers before it sends them on (at most 2 ** 21, so that three
#: numbers of words are one key), and tokens for each shard of n-grams.
GATHERED, PER_SHARD = 2_000_000, 3_000_000
#: Bytes of files that a worker holds where they lie in a store that can't be mapped.
HELD_BYTES = 128 << 20
#: Different words whose counts a task holds before it sends them on.
COUNTED = 1_000_000
#: Fixed value: stands for the end of a text, and as a context for its begin.
END = 0x9AE16A3B2F90404F
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone change case


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    g = (v * _ODD) ^ (w + (v >> np.uint64(31)))
    g = (g ^ (g >> np.uint64(30))) * _MIX
    return g ^ (g >> np.uint64(27))


def range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def among(hot: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of v are in `hot` (sorted)."""
    if not len(hot):
        return np.zeros(len(v), bool)
    k = np.searchsorted(hot, v)
    k[k == len(hot)] = 0
    return hot[k] == v


def gram_shard(v: np.ndarray, spread: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the word v, or by the hash `spread` where that word is one of `hot`."""
    at = range_shard(v, shards)
    often = among(hot, v)
    at[often] = range_shard(spread[often], shards)
    return at


class WordTable:
    """Numbers of words with their hashes."""

    def __init__(self) -> None:
        self.numbers = Numbers(words_of, self._learn, most=200_000)
        self.hash = np.zeros(1 << 16, np.uint64)

    def _learn(self, words: list[bytes], first: int) -> None:
        self.hash = grown(self.hash, first + len(words))
        self.hash[first : first + len(words)] = hash_words(words)


def chained(words: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the word before that, the word before, the word) of all words and ends of all texts.

    What comes before the first word is `end`, twice.
    """
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.full(int(sizes.sum()) + len(sizes), end, words.dtype)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = words
    before, earlier = np.full_like(tokens, end), np.full_like(tokens, end)
    before[1:] = tokens[:-1]
    earlier[2:] = tokens[:-2]
    earlier[ends - sizes] = end
    return earlier, before, tokens


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, with the sums of their counts."""
    h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return h, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words (as signed hashes; the end of each text is one) and counts."""

    def told() -> pa.RecordBatch:
        h, c = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["word", "n"])

    table = kept("kn-words", "", WordTable)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in pieces(batches, "text"):
        at, sizes = table.numbers.batch(texts_of(batch, "text"))
        at, c = np.unique(at, return_counts=True)
        held += [(table.hash[at], c), (np.array([END], np.uint64), np.array([len(sizes)]))]
        if sum(len(h) for h, _ in held) > 2 * COUNTED:
            held = [_merged(held)]
            if len(held[0][0]) > COUNTED:
                yield told()
                held = []
    if held:
        yield told()


#: Fixed value: where there are fewest shards, no more words than this have the share of a frequent one.
FEW = 32


def _frequent(least: float):
    """Of a partition of summed words those with more than `least`, its first FEW, and the sum of the others (no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, others = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            words, n = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((words, "word"), (n, "n")))
            stays = n > least
            stays[np.argsort(-n, kind="stable")[:FEW]] = True
            others += int(n[~stays].sum())
            words, n = words[stays], n[stays]
        yield pa.RecordBatch.from_arrays([pa.array([*words.tolist(), None], pa.int64()), pa.array([*n.tolist(), others], pa.int64())], names=["word", "n"])

    return run


def layout(lean: DataFrame, per_shard: int) -> tuple[int, np.ndarray]:
    """The number of shards, and the words (sorted hashes) that come so often that their followers are spread.

    These are words with more than an eighth of a shard's tokens: with more than FEW // 8 shards
    that is at least per_shard / 8; with so many or fewer, less than FEW words can have that share.
    """
    sums = lean.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = sums.mapInArrow(_frequent(per_shard / 8), "word long, n long").collect()
    total = sum(r["n"] for r in rows)
    shards = max(FEW // 8, total // per_shard)
    often = [r["word"] for r in rows if r["word"] is not None and r["n"] * 8 * shards > total]
    return shards, np.unique(np.append(np.array(often, np.int64).view(np.uint64), np.uint64(END)))


GRAM_BLOBS = "shard int, words binary, context binary, runs binary, last binary, c binary, wide boolean"
#: Fixed value: bits of a word's number in a key of three.
_BITS = 21


def _numbers(x: np.ndarray, wide: bool) -> bytes:
    return x.astype(np.uint32 if wide else np.uint16).tobytes()


def _told(tokens: tuple[np.ndarray, ...], order: int, hot: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of GRAM_BLOBS with the n-grams of some texts: runs of one context, as numbers of a blob's words."""
    tokens = tokens[-order:]
    # What comes before the first words may be none of these tokens.
    words = np.unique(np.concatenate([tokens[-1], np.array([END], np.uint64), *(x[:2] for x in tokens[:-1])]))
    numbers = [np.searchsorted(words, x) for x in tokens]
    low = (1 << _BITS) - 1
    key = np.zeros(len(tokens[-1]), np.uint64)
    for x in numbers:
        key = (key << np.uint64(_BITS)) | x.astype(np.uint64)
    key, c = np.unique(key, return_counts=True)
    parts = [((key >> np.uint64(_BITS * (order - 1 - k))) & np.uint64(low)).astype(np.int64) for k in range(order)]
    v = words[parts[-2]]
    shard = gram_shard(v, pair_hash(words[parts[0]], v if order == 3 else words[parts[1]]), hot, shards)
    by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    parts, c, shard = [x[by] for x in parts], c[by], shard[by]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(c)]])
    local = np.zeros(len(words), np.int64)
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = [x[s:e] for x in parts]
        used = np.zeros(len(words), bool)
        for x in own:
            used[x] = True
        some = np.flatnonzero(used)
        local[some] = np.arange(len(some))
        own = [local[x] for x in own]
        change = np.any([x[1:] != x[:-1] for x in own[:-1]], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        runs = np.diff(np.append(starts, e - s))
        wide = len(some) > 1 << 16 or int(runs.max()) >= 1 << 16
        context = b"".join(_numbers(x[starts], wide) for x in own[:-1])
        counts = c[s:e]
        # Counts over 254 follow the bytes, in turn.
        more = counts[counts > 254].astype(np.uint32).tobytes()
        yield int(shard[s]), words[some].tobytes(), context, _numbers(runs, wide), _numbers(own[-1], wide), np.minimum(counts, 255).astype(np.uint8).tobytes() + more, wide


def _read(row: dict, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words' hashes, and the counts, of the n-grams of a blob."""
    kind = np.uint32 if row["wide"] else np.uint16
    words, runs, last = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["runs"], kind), np.frombuffer(row["last"], kind)
    c = np.frombuffer(row["c"], np.uint8, len(last)).astype(np.int64)
    c[c == 255] = np.frombuffer(row["c"], np.uint8)[len(last) :].view(np.uint32)
    context = np.frombuffer(row["context"], kind).reshape(order - 1, len(runs))
    return [*(np.repeat(words[x], runs) for x in context), words[last]], c


def _count(order: int, shards: int, hot: np.ndarray):
    def rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = tuple(np.concatenate(x) for x in zip(*held))
        for first in range(0, len(tokens[0]), GATHERED):
            for row in _told(tuple(x[first : first + GATHERED] for x in tokens), order, hot, shards):
                kinds = (pa.int32(), *[pa.binary()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in GRAM_BLOBS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept("kn-words", "", WordTable)
        held: list[tuple] = []
        tokens = 0
        for batch in pieces(batches, "text", 4 << 20):
            at, sizes = table.numbers.batch(texts_of(batch, "text"))
            if tokens and tokens + len(at) + len(sizes) > GATHERED:
                yield from rows(held)
                held, tokens = [], 0
            held.append(chained(table.hash[at], sizes, END))
            tokens += len(held[-1][0])
        if held:
            yield from rows(held)

    return run


def packed(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """A sorted hash array with columns of small numbers, of which the first is the greatest.

    48 bits of a key are kept, so of n keys a strange one is taken for one of them with probability
    n / 2 ** 48. A first column of 255 and more is marked, and the row's numbers are kept apart.
    """
    keys = keys >> np.uint64(16)
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    over = np.flatnonzero(columns[0] >= 255)
    sizes = np.array([len(keys), len(over)], np.uint64)
    apart = [over.astype(np.uint32), *(c[over].astype(np.uint32) for c in columns)]
    small = [np.minimum(c, 255).astype(np.uint8) for c in columns]
    return [sizes, (keys >> np.uint64(16)).astype(np.uint32), *apart, (keys & np.uint64(0xFFFF)).astype(np.uint16), *small]


class Packed:
    """What `packed` wrote, mapped or held; looked up by hash."""

    def __init__(self, data: np.ndarray, columns: int):
        n, m = (int(x) for x in data[:16].view(np.uint64))
        at = 16

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = data[at : at + np.dtype(kind).itemsize * count].view(kind)
            at += out.nbytes
            return out

        self.high = take(np.uint32, n)
        self.over, self.apart = take(np.uint32, m), [take(np.uint32, m) for _ in range(columns)]
        self.low = take(np.uint16, n)
        self.small = [take(np.uint8, n) for _ in range(columns)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The columns of each key, by row; zeros where it is not known."""
        out = np.zeros((len(keys), len(self.small)), np.int64)
        if not len(self.high):
            return out
        high, low = (keys >> np.uint64(32)).astype(np.uint32), ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)
        k = np.searchsorted(self.high, high)
        k[k == len(self.high)] = 0
        rows = np.flatnonzero(self.high[k] == high)
        k = k[rows]
        while len(rows):
            same = self.low[k] == low[rows]
            hit, on = k[same], rows[same]
            for c, column in enumerate(self.small):
                out[on, c] = column[hit]
            great = np.flatnonzero(out[on, 0] == 255)
            if len(great):
                at = np.searchsorted(self.over, hit[great])
                for c, column in enumerate(self.apart):
                    out[on[great], c] = column[at]
            # Another key with the same first 32 bits may follow.
            k, rows = k[~same] + 1, rows[~same]
            more = k < len(self.high)
            k, rows = k[more], rows[more]
            more = self.high[k] == high[rows]
            k, rows = k[more], rows[more]
        return out


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """The arrays, one after the other, as the file `name`.

    It appears whole or not at all. A task that is run again writes the same bytes under the same name.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    try:
        store.move(part, f"{root}/{name}")
    except OSError:  # a store that doesn't replace: the other run's file is as good
        if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
            raise
        store.delete_file(part)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches by their shard."""
    shard, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard and rows:
                yield shard, rows
                rows = []
            shard = row["shard"]
            rows.append(row)
    if rows:
        yield shard, rows


WORD_BLOBS = "shard int, kind string, blob binary, meta string"
#: Arrays that go to word shards, by kind. v: a word, its count, and as a context of pairs their
#: sum and how many are 1, 2, more. w: a word and after how many words it comes. hot: a pair and its count.
KINDS = {"v": (np.uint64,) * 3 + (np.uint32,) * 3, "w": (np.uint64,) * 2, "hot": (np.uint64,) * 3}
#: Arrays of a word shard: those of v, and after how many words it comes.
WORD_ARRAYS = (*KINDS["v"], np.uint64)
#: Sums that the model needs, of n-grams, pairs and words; and of each frequent word as a context of pairs.
FACTS = ("tokens", "words", "before", "seen1", "seen2", "seen3", "seen4", "more")


def _followers(back: np.ndarray, c: np.ndarray, n: int) -> list[np.ndarray]:
    """Of n contexts the sum of their followers' counts, and how many of these are 1, 2 and more."""
    return [np.bincount(back, c, n).astype(np.int64), *(np.bincount(back, x, n).astype(np.int64) for x in (c == 1, c == 2, c > 2))]


def _seen(c: np.ndarray) -> dict[str, int]:
    return {f"seen{k}": int((c == k).sum()) for k in (1, 2, 3, 4)}


def _add_grams(order: int, folder: str, word_shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches):
            read = [_read(r, order) for r in rows]
            del rows
            words = [np.concatenate(x) for x in zip(*(w for w, _ in read))]
            c = np.concatenate([x for _, x in read])
            del read
            context = pair_hash(words[0], words[1]) if order == 3 else words[0]
            g, at, back = np.unique(pair_hash(context, words[-1]), return_index=True, return_inverse=True)
            c = np.bincount(back, c).astype(np.int64)
            words, context = [x[at] for x in words], context[at]
            del back, at
            v, w = words[-2:]
            facts = [("grams", {"tokens": int(c.sum())} | _seen(c))]
            raw, of = np.unique(v, return_inverse=True)
            raw_count = np.bincount(of, c).astype(np.int64)
            if order == 3:
                _write(folder, f"grams-{shard}", packed(g, [c]))
                known, at, back = np.unique(context, return_index=True, return_inverse=True)
                about = _followers(back, c, len(known))
                stays = (about[0] > 1) | (v[at] == np.uint64(END))
                _write(folder, f"contexts-{shard}", packed(known[stays], [x[stays] for x in about]))
                del known, back, about
                # A pair counts once for each word before it.
                g, at, c = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
                v, w, of = v[at], w[at], of[at]
            often = among(hot, v)
            cold = ~often
            _write(folder, f"pairs-{shard}", packed(g[cold], [c[cold]]))
            facts.append(("pairs", _seen(c[cold])))
            tables = {
                "v": [raw, raw_count, *_followers(of[cold], c[cold], len(raw))],
                "w": list(np.unique(w[cold], return_counts=True)),
                "hot": [w[often], v[often], c[often]],
            }
            tables["hot"] = [x[np.argsort(w[often], kind="stable")] for x in tables["hot"]]
            out = [(shard % word_shards, kind, b"", json.dumps(f)) for kind, f in facts]
            for kind, arrays in tables.items():
                cut = np.searchsorted(range_shard(arrays[0], word_shards), np.arange(word_shards + 1))
                for k in range(word_shards):
                    part = slice(cut[k], cut[k + 1])
                    if cut[k] < cut[k + 1]:
                        out.append((k, kind, b"".join(a[part].astype(t).tobytes() for a, t in zip(arrays, KINDS[kind])), ""))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.string()))], names=["shard", "kind", "blob", "meta"])

    return run


def _split(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _add_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: list[tuple[str, int, dict]] = []
        for shard, rows in _grouped(batches):
            said += [(r["kind"], 0, json.loads(r["meta"])) for r in rows if r["meta"]]
            parts = {k: [_split(r["blob"], kinds) for r in rows if r["kind"] == k] for k, kinds in KINDS.items()}
            if not any(parts.values()):
                continue
            v, w, hot = ([np.concatenate(x) for x in zip(*parts[k])] if parts[k] else [np.zeros(0, t) for t in kinds] for k, kinds in KINDS.items())
            second, first, c = hot
            g, at, back = np.unique(pair_hash(first, second), return_index=True, return_inverse=True)
            c, first, second = np.bincount(back, c, len(g)).astype(np.int64), first[at], second[at]
            _write(folder, f"hot-{shard}", packed(g, [c]))
            said.append(("pairs", 0, _seen(c)))
            often, back = np.unique(first, return_inverse=True)
            for word, *about in zip(often.view(np.int64).tolist(), *(x.tolist() for x in _followers(back, c, len(often)))):
                said.append(("hot", word, dict(zip(("tokens", "seen1", "seen2", "more"), about))))
            words, back = np.unique(np.concatenate([v[0], w[0], second]), return_inverse=True)
            n = len(words)
            sums = [np.bincount(back[: len(v[0])], x, n) for x in v[1:]]
            before = np.bincount(back[len(v[0]) :], np.concatenate([w[1], np.ones(len(second), np.uint64)]), n)
            _write(folder, f"words-{shard}", [a.astype(k) for a, k in zip([words, *sums, before], WORD_ARRAYS)])
            said.append(("words", 0, {"words": n, "before": int(before.sum()), "more": int((before > 2).sum())} | _seen(before)))
        if said:
            columns = [pa.array([k for k, _, _ in said]), pa.array([w for _, w, _ in said], pa.int64()), *(pa.array([f.get(c, 0) for _, _, f in said], pa.int64()) for c in FACTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "word", *FACTS])

    return run


def discounts(seen: list[int]) -> list[float]:
    """The discounts for counts of one, two and more, from how many counts are 1, 2, 3 and 4.

    Where these are too few for the formula, or it leaves its range, 0.5, 1 and 1.5 are taken.
    """
    out = [0.5, 1.0, 1.5]
    if all(seen):
        y = seen[0] / (seen[0] + 2 * seen[1])
        for k in range(3):
            d = k + 1 - (k + 2) * y * seen[k + 1] / seen[k]
            if 0 < d < k + 1:
                out[k] = d
    return out


class Model:
    """What scoring needs besides the files: a few numbers, and some for each frequent word."""

    def __init__(self, folder: str, order: int, facts: dict[str, dict[str, int]], about: dict[int, list[int]], shards: int, word_shards: int, hot: np.ndarray):
        self.folder, self.order, self.shards, self.word_shards, self.hot = folder, order, shards, word_shards, hot
        grams, pairs, words = (facts.get(k, dict.fromkeys(FACTS, 0)) for k in ("grams", "pairs", "words"))
        self.tokens, self.distinct, self.before = grams["tokens"], words["words"], words["before"]
        self.gram_discount, self.discount, self.word_discount = (discounts([f[f"seen{k}"] for k in (1, 2, 3, 4)]) for f in (grams, pairs, words))
        spare = sum(d * n for d, n in zip(self.word_discount, (words["seen1"], words["seen2"], words["more"])))
        #: Probability of each word that is not known.
        self.floor = (spare / self.before if self.before else 1.0) / (self.distinct + 1)
        #: Of each frequent word the sum of its pairs, and how many are 1, 2, more.
        self.hot_about = np.array([about.get(h, [0, 0, 0, 0]) for h in hot.view(np.int64).tolist()], np.int64).reshape(-1, 4)


def _subtracted(count: np.ndarray, discount: list[float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *discount])[np.minimum(count, 3).astype(np.int64)], 0.0)


def _spare(about: np.ndarray, discount: list[float]) -> np.ndarray:
    """The share that contexts (sum, ones, twos, more) keep for followers of the lower order."""
    return about[:, 1:] @ np.array(discount) / np.maximum(about[:, 0], 1)


class Scorer:
    """Maps the model's files into memory and scores texts."""

    def __init__(self, model: Model):
        self.model = model
        self.opened: dict[str, object] = {}
        self.held = 0
        self.numbers = Numbers(words_of, self._learn)
        self.hash = np.zeros(1 << 16, np.uint64)
        #: By word: probability without context, log10 of the base estimate, known, sum of its pairs, share kept for unseen followers.
        self.facts = np.zeros((1 << 16, 5))
        self.end = self._facts(np.array([END], np.uint64))[0]

    def _bytes(self, name: str) -> np.ndarray | None:
        """A file's bytes, mapped into memory; None where the shard has none.

        From a store that can't be mapped they are read, and at most HELD_BYTES of such files are held.
        """
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.model.folder)
        path = f"{root}/{name}"
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound or not info.size:
            return None
        if isinstance(store, fs.LocalFileSystem):
            return np.asarray(np.memmap(path, np.uint8, "r"))
        if self.held + info.size > HELD_BYTES:
            self.opened, self.held = {}, 0
        self.held += info.size
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.uint8)

    def _opened(self, name: str, made) -> object:
        if name not in self.opened:
            data = self._bytes(name)
            self.opened[name] = None if data is None else made(data)
        return self.opened[name]

    def _find(self, name: str, columns: int, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The columns of keys in the files of their shards, sorted by shard first."""
        out = np.zeros((len(keys), columns), np.int64)
        order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(keys)]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if s < e and (table := self._opened(f"{name}-{shard[order[s]]}", lambda d: Packed(d, columns))) is not None:
                out[order[s:e]] = table.find(keys[order[s:e]])
        return out

    def _facts(self, h: np.ndarray) -> np.ndarray:
        m = self.model
        found = np.zeros((len(h), 6))  # count, sum of pairs, ones, twos, more, before
        order = np.argsort(h)
        shard = range_shard(h[order], m.word_shards)
        for s in np.unique(shard).tolist():
            arrays = self._opened(f"words-{s}", lambda d: _split(d, WORD_ARRAYS))
            if arrays is None:
                continue
            on = order[shard == s]
            words, *rest = arrays
            k = np.searchsorted(words, h[on])
            k[k == len(words)] = 0
            same = words[k] == h[on]
            for c, array in enumerate(rest):
                found[on[same], c] = array[k[same]]
        often = np.flatnonzero(among(m.hot, h))
        found[often, 1:5] = m.hot_about[np.searchsorted(m.hot, h[often])]
        count, before = found[:, 0], found[:, 5]
        p = _subtracted(before, m.word_discount) / max(1, m.before) + m.floor
        base = np.log10((count + 1) / (m.tokens + m.distinct + 1))
        return np.stack([p, base, count > 0, found[:, 1], _spare(found[:, 1:5], m.discount)], axis=1)

    def _learn(self, words: list[bytes], first: int) -> None:
        last = first + len(words)
        self.hash, self.facts = grown(self.hash, last), grown(self.facts, last)
        self.hash[first:last] = hash_words(words)
        self.facts[first:last] = self._facts(self.hash[first:last])

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The counts of pairs in the model's pair level."""
        m = self.model
        key, back = np.unique(pair_hash(v, w), return_inverse=True)
        first, second = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
        first[back], second[back] = v, w
        often = among(m.hot, first)
        found = np.zeros(len(key), np.int64)
        for name, on, shard in (("pairs", ~often, range_shard(first, m.shards)), ("hot", often, range_shard(second, m.word_shards))):
            found[on] = self._find(name, 1, key[on], shard[on])[:, 0]
        return found[back]

    def score(self, texts: list[str]) -> list[np.ndarray]:
        """tokens, known tokens, base score and score of each text."""
        m = self.model
        at, sizes = self.numbers.batch(texts)
        facts = np.concatenate([self.facts[at], self.end[None]])
        earlier, before, token = chained(np.arange(len(at)), sizes, len(at))
        h = np.append(self.hash[at], np.uint64(END))
        u, v, w = h[earlier], h[before], h[token]
        pairs = self.pair_counts(v, w)
        p, base, known = facts[token, 0], facts[token, 1], facts[token, 2]
        total, spare = facts[before, 3], facts[before, 4]
        p = np.where(total > 0, _subtracted(pairs, m.discount) / np.maximum(total, 1) + spare * p, p)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        if m.order == 3:
            context = pair_hash(u, v)
            shard = gram_shard(v, context, m.hot, m.shards)
            # A context that is no key but a known pair was followed once.
            once = np.zeros(len(w), bool)
            once[1:] = pairs[:-1] > 0
            once[starts] = False
            about = np.zeros((len(w), 4), np.int64)
            about[once, :2] = 1
            asked = once.copy()
            asked[starts] = True
            some = np.flatnonzero(asked)
            key, first, back = np.unique(context[some], return_index=True, return_inverse=True)
            found = self._find("contexts", 4, key, shard[some][first])[back]
            there = found[:, 0] > 0
            about[some[there]] = found[there]
            on = np.flatnonzero(about[:, 0])
            c = np.zeros(len(w), np.int64)
            # A triple is known only if its last two words are a known pair.
            on = on[pairs[on] > 0]
            c[on] = self._find("grams", 1, pair_hash(context[on], w[on]), shard[on])[:, 0]
            p = np.where(about[:, 0] > 0, _subtracted(c, m.gram_discount) / np.maximum(about[:, 0], 1) + _spare(about, m.gram_discount) * p, p)
        return [sizes + 1, *(np.add.reduceat(x, starts) for x in (known, base, np.log10(p)))]


def fit(docs: DataFrame, text_col: str = "text", per_shard: int = PER_SHARD, order: int = ORDER) -> Model:
    """Count all texts of docs (null: empty) and write the model's files to the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    lean = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    shards, hot = layout(lean, per_shard)
    word_shards = max(2, shards // 4)
    folder = new_dir(spark, "kneser-ney")
    grams = lean.mapInArrow(_count(order, shards, hot), GRAM_BLOBS)
    words = grams.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_add_grams(order, folder, word_shards, hot), WORD_BLOBS)
    said = words.repartitionById(word_shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_add_words(folder), ", ".join(["kind string", "word long", *(f"{c} long" for c in FACTS)]))
    sums = said.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in FACTS]).collect()  # three rows, and one for each frequent word
    facts = {r["kind"]: {c: r[c] for c in FACTS} for r in sums if r["kind"] != "hot"}
    about = {r["word"]: [r[c] for c in ("tokens", "seen1", "seen2", "more")] for r in sums if r["kind"] == "hot"}
    return Model(folder, order, facts, about, shards, word_shards, hot)


def score_documents(docs: DataFrame, model: Model, held_out: F.Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """SCHEMA's columns for every row of docs."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept("kneser-ney", key, lambda: Scorer(shared.value))
        for batch in pieces(batches, "text", 4 << 20):
            tokens, known, base, score = scorer.score(texts_of(batch, "text"))
            total = pa.array(np.full(batch.num_rows, scorer.model.tokens))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(known.astype(np.int64)), total, pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return lean.mapInArrow(run, SCHEMA)


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, text_col: str = "text", id_col: str = "doc_id", per_shard: int = PER_SHARD, order: int = ORDER) -> DataFrame:
    """Train on the documents that are not held out and score all of them, one row each.

    order is the words of an n-gram, 2 or 3. Perplexity is 10 ** (-score / n_tokens). Null texts are
    the end token alone. With nothing to train on both scores are 0. Repeated rows are trained on and
    scored as often as they occur; a null id is in the fold of the empty text; other columns are not
    read; an empty table gives no rows. Words are compared by a 64-bit hash, pairs and triples by
    48 bits of one within their shard. A text is scored by one task in memory that grows with it.
    """
    held_out = crc_bucket(id_col, folds) == held
    return score_documents(docs, fit(docs.filter(~held_out), text_col, per_shard, order), held_out, text_col, id_col)
