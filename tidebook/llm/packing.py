"""Best-fit packing by hierarchical residual packing.

Documents become token ids with an end id; longer ones are cut into pieces of the sequence
length. Full pieces are sequences of their own. Shorter pieces are dealt at random over
partitions, each of which packs its own by best fit, longest first, and emits the bins that
are nearly full. What is left are underfull bins, and these are the items of the next round,
over fewer partitions, up the tree, until one group holds them all. An underfull bin carries
only the keys and lengths of its pieces.

Best fit leaves no two bins of a group that would fit together, so at most one of them is half
full or less. A later round can only add such bins to others, one for each group below it, and
for that the bins with most room are enough. So of its other bins a group hands up those
with most room, as many as there are groups below one node of the tree in all rounds, and emits
the rest: they are as full as they can get.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, staged, texts_of
from .memo import Numbers, grown, kept

SEQUENCE = 2048
#: A bin with at most this share of room left is emitted before the last round.
SLACK = 0.01
FAN_IN = 64
#: Rounds for which a group hands up bins with room: enough for FAN_IN ** ROUNDS groups.
ROUNDS = 4
#: Items that one task packs in the first round (about 24 bytes each).
ITEMS_PER_TASK = 200_000

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


# How the tokenizer cuts a normalised text into parts that it encodes one by one,
# for texts within Latin-1: letters, single numerals, contractions, and what else is not space.
LETTERS, NUMERALS, BLANK = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
PARTS = re.compile(f"[{LETTERS}]+|[{NUMERALS}]|'(?:s|t|re|ve|m|ll|d)|[^{BLANK}{LETTERS}{NUMERALS}]+")
BEYOND = re.compile("[^\u0000-\u00ff]")
#: New parts that the tokenizer gets as one text.
JOINED = 64


def parts_of(text: str) -> list[str]:
    """Parts whose ids, in turn, are those of the text.

    Within Latin-1 normalising only puts letters in lower case and spaces together. In other texts
    words with other characters stay whole, since no token crosses white space.
    """
    if not BEYOND.search(text):
        return PARTS.findall(text.lower())
    out: list[str] = []
    for w in text.encode("utf-8", "replace").split():
        word = w.decode("utf-8")
        out += [word] if BEYOND.search(word) else PARTS.findall(word.lower())
    return out


class Encoder:
    """Ids of whole texts, remembering those of the parts already met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size() if suffix else 0, bool)
        self.ends[[i for s, i in self.tokenizer.get_vocab().items() if suffix and s.endswith(suffix)]] = True
        self.numbers = Numbers(parts_of, self._learn, most=500_000)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in turn, and how many belong to each.

        Parts within Latin-1 are one word each, so many are encoded as one text with spaces between, and the ids that end
        a word tell them apart. Where these are not as many as the parts, or characters are beyond, each is encoded alone.
        """
        if not len(self.ends):
            return self._alone(parts)
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        texts, out = [" ".join(g) for g in groups], []
        for group, text, found in zip(groups, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            flat = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            plain = len(ends) == len(group) and ends[-1] == len(flat) and not BEYOND.search(text) and not (self.special and self.special.search(text))
            out.append((flat, np.diff(ends, prepend=0)) if plain else self._alone(group))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _learn(self, parts: list[str], first: int) -> None:
        flat, sizes = self._encoded(parts)
        used = int(self.begin[first - 1] + self.count[first - 1]) if first else 0
        total, last = int(sizes.sum()), first + len(parts)
        self.ids, self.begin, self.count = grown(self.ids, used + total), grown(self.begin, last), grown(self.count, last)
        self.ids[used : used + total] = flat
        self.begin[first:last] = used + np.cumsum(sizes) - sizes
        self.count[first:last] = sizes

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with id 0 after the last.

        A text that spells out one of the tokenizer's special tokens is encoded whole.
        """
        whole = [k for k, t in enumerate(texts) if self.special and self.special.search(t)]
        if whole:
            out = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)))
            others = iter(self.batch([t for k, t in enumerate(texts) if k not in out]))
            return [np.append(np.array(out[k].ids, np.uint32), np.uint32(0)) if k in out else next(others) for k in range(len(texts))]
        if not texts:
            return []
        at, parts = self.numbers.batch(texts)
        sizes = self.count[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], sizes)]
        return [np.append(x, np.uint32(0)) for x in np.split(flat, ends[np.cumsum(parts)][:-1])]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: row (number of the input row), doc_id, piece, start, length, ids_crc32.

    with_ids adds the ids themselves (little-endian unsigned 32-bit, binary).
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("encoder", tokenizer, lambda: Encoder(tokenizer))
        for batch in pieces(batches, "text", 2 << 20):
            out: list[tuple] = []
            rows, keys = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for row, key, ids in zip(rows, keys, encoder.batch(texts_of(batch, "text"))):
                for k, i in enumerate(range(0, len(ids), length)):
                    part = ids[i : i + length].astype("<u4", copy=False).tobytes()
                    out.append((row, key, k, i, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    lean = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return lean.mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    levels: list[int] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(levels, n)
        if k == len(levels):
            bin_, left = made, room - n
            made += 1
        else:
            left = levels[k]
            bin_ = free[left].pop()
            if not free[left]:
                del free[left]
                levels.pop(k)
            left -= n
        bins[i] = bin_
        if left:
            if left not in free:
                free[left] = []
                insort(levels, left)
            free[left].append(bin_)
    return bins


BINS = "seq long, used int, full boolean, members array<long>, sizes array<int>, starts array<long>"


def _handed_up(total: np.ndarray, length: int, least: int, carried: int) -> np.ndarray:
    """Which bins go up the tree: those half full or less, and of the others below `least` the `carried` with most room."""
    up = 2 * total <= length
    others = np.flatnonzero(~up & (total < least))
    up[others[np.argsort(total[others], kind="stable")[:carried]]] = True
    return up


def _pack_group(length: int, least: int, level: int, carried: int):
    """Pack the bins of one partition as items; `full` are the bins that are not handed up.

    Bins are numbered by level, partition and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        used = t.column("used").to_numpy().astype(np.int64)
        bins = best_fit(used, length)
        order = np.argsort(bins, kind="stable")
        rows = t.select(["members", "sizes"]).combine_chunks().take(pa.array(order))
        members, sizes = (rows.column(c).combine_chunks() for c in ("members", "sizes"))
        counts = np.bincount(bins)  # items of each bin
        items = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
        ends = items[np.cumsum(counts)]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        total = np.bincount(bins, used).astype(np.int32)
        flat = sizes.flatten()
        before = np.concatenate([[0], np.cumsum(flat.to_numpy().astype(np.int64))])
        starts = before[:-1] - np.repeat(before[ends] - total, np.diff(np.concatenate([[0], ends])))
        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        columns = {
            "seq": pa.array(first + np.arange(len(total))),
            "used": pa.array(total),
            "full": pa.array(~_handed_up(total, length, least, carried)),
            "members": pa.ListArray.from_arrays(offsets, members.flatten()),
            "sizes": pa.ListArray.from_arrays(offsets, flat),
            "starts": pa.ListArray.from_arrays(offsets, pa.array(starts)),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def pack_items(items: DataFrame, length: int = SEQUENCE, slack: float = SLACK, items_per_task: int = ITEMS_PER_TASK, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """(item, size) -> (item, seq, offset): every item once, sizes of 1 to `length`.

    `item` must be unique. After the first round a group hands up at most one bin that is half
    full or less and fan_in x rounds others. Every round goes on with a `fan_in`-th of the groups,
    down to one. A round's result is written to the shared folder, so a lost executor repeats one
    round at most.
    """
    least, carried = length - int(length * slack), fan_in * rounds
    n = items.count()
    tasks = max(1, -(-n // items_per_task))
    bins = items.select(
        F.col("size").cast("int").alias("used"), F.array("item").alias("members"), F.array(F.col("size").cast("int")).alias("sizes"), F.xxhash64("item").alias("deal")
    )
    done: list[DataFrame] = []
    level = 0
    while True:
        packed = bins.repartition(tasks, "deal").select("used", "members", "sizes").mapInArrow(_pack_group(length, least, level, carried), BINS)
        packed = staged(packed, "bins")
        done.append(packed if tasks == 1 else packed.filter("full"))
        if tasks == 1:
            break
        left = packed.filter(~F.col("full"))
        level, tasks = level + 1, -(-tasks // fan_in)
        bins = left.select("used", "members", "sizes", F.xxhash64("seq").alias("deal"))
    every = done[0]
    for other in done[1:]:
        every = every.unionByName(other)
    return every.select("seq", F.inline(F.arrays_zip(F.col("members").alias("item"), F.col("starts").alias("offset"))).alias("item", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False, **settings) -> DataFrame:
    """Pack every document into sequences of at most `length` tokens; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). The ids are those of
    the tokenizer, also where a text spells out a special token. Null and empty texts are a document
    of the end id alone. Repeated rows and null ids are packed like any other row; other columns are
    not read. An empty table gives no rows. Ties between bins go to the one freed last. A very long
    text is encoded by one task and cut into as many full sequences as it fills.
    """
    cut = staged(token_pieces(docs, tokenizer, length, text_col, id_col, with_ids), "pieces")
    short = F.col("length") < length
    # Only the last piece of a row is short, so the row number is the item's key.
    placed = pack_items(cut.filter(short).select(F.col("row").alias("item"), F.col("length").alias("size")), length, **settings)
    alone = cut.filter(~short).withColumns({"seq": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    packed = cut.filter(short).join(placed.withColumnRenamed("item", "row"), "row")
    columns = [c for c in cut.columns if c != "row"]
    every = alone.select(*columns, "seq", "offset").unionByName(packed.select(*columns, "seq", "offset"))
    return every.select(*columns, F.col("seq").alias("sequence_id"), "offset")
