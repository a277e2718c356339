"""Spelling variant grouping without pairs.

A word stands in a group for each of its places: (place, prefix, suffix), the word with that place
left open. Words of a group differ in one replaced character; a group keeps its size and its
two best words, so each member learns how many others there are and which is the best of them.
Words with a character left out meet the vocabulary in the same way: a word that others
reach by a deletion learns how many they are and the best of them, and each of them learns of
that word. A member's rows are then added up; pairs are never listed.

Words are numbered in their order of preference (most occurrences first, then code points), so
the best of several words is the least number, and rows between stages hold a 16-byte key and a number,
however long a word is. Work and rows of a word are linear in its length, its characters are
hashed in one pass where it is long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, slices, staged, utf8

#: Code points of a word at least, its occurrences at least, and how many times as frequent a form is.
LEAST, OCCURRENCES, TIMES = 7, 2, 10
#: A run in h of these many has a character deleted.
ONE_IN = 31
#: Words that a task counts before it hands their partial counts on, and their characters.
HELD, HELD_CHARS = 300_000, 16 << 20
#: Keys of words longer than this are hashed in one pass over the word, CHUNK characters at a time.
LONG, CHUNK = 1024, 1 << 16
#: Primes and bases of the polynomials that hash long words.
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([1103515245, 1812433253, 1566083941, 1664525], np.uint64)

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
_BREAK = re.compile("[^a-zÀ-ÿ]")


def words_of(text: bytes, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """Words of a text with how often it has them, changed as their hash with the document's id asks."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for part in slices(text.lower().decode("utf-8", "surrogatepass"), _BREAK):
        found.update(_RUN.findall(part))
    for run, n in found.items():
        h = zlib.crc32(run.encode("utf-8", "surrogatepass"), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        yield run, n


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    chars = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in pieces([batch], "text", 4 << 20):
            for text, doc_id in zip(utf8(part.column("text")), part.column("doc_id").to_pylist()):
                for word, n in words_of(text, doc_id):
                    if word not in held:
                        chars += len(word)
                    held[word] += n
            if len(held) > HELD or chars > HELD_CHARS:
                yield out()
                held.clear()
                chars = 0
    if held:
        yield out()


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, word, n): words with enough occurrences, numbered from most occurrences to fewest, then by code points."""
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    counts = lean.mapInArrow(_partial_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)
    return staged(staged(counts, "words").orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")


OPEN, DELETED, ITSELF = 0, 1, 2


def _digest(word: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))


def _packed(values: np.ndarray, is_open: bool) -> bytes:
    """16 bytes of each row of four values below 2 ** 31; the top bit tells an open place."""
    both = (values[:, 0::2] << np.uint64(32)) | values[:, 1::2]
    both[:, 0] |= np.uint64(is_open) << np.uint64(63)
    return np.ascontiguousarray(both).tobytes()


def _chunks(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, values): each character times its power, modulo each prime; a row per character."""
    power = np.ones((1, 4), np.uint64)
    while len(power) < min(CHUNK, len(code)):
        power = np.concatenate([power, power * (power[-1] * _BASES % _PRIMES) % _PRIMES])
    times, whole = np.ones(4, np.uint64), np.array([pow(int(b), CHUNK, int(p)) for b, p in zip(_BASES, _PRIMES)], np.uint64)
    for start in range(0, len(code), CHUNK):
        part = code[start : start + CHUNK]
        yield start, part[:, None] * power[: len(part)] % _PRIMES * times % _PRIMES
        times = times * whole % _PRIMES


def _long_keys(word: str) -> Iterator[tuple[int, bytes]]:
    """As keys() has them. A word is a polynomial of its characters (an open place is zero); a deletion
    takes what follows down by one power."""
    code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    total = np.zeros(4, np.uint64)
    for _, value in _chunks(code):
        total = (total + value.sum(axis=0)) % _PRIMES
    down = np.array([pow(int(b), -1, int(p)) for b, p in zip(_BASES, _PRIMES)], np.uint64)
    before = np.zeros(4, np.uint64)
    last = np.append(code[1:] != code[:-1], True)  # of a run of equal characters one deletion is told
    for start, value in _chunks(code):
        yield OPEN, _packed((total + _PRIMES - value) % _PRIMES, True)
        upto = (before + np.cumsum(value, axis=0)) % _PRIMES
        shorter = (upto + _PRIMES - value + (total + _PRIMES - upto) % _PRIMES * down) % _PRIMES
        yield DELETED, _packed(shorter[last[start : start + CHUNK]], False)
        before = upto[-1]
    yield ITSELF, _packed(total[None], False)


def keys(word: str) -> Iterator[tuple[int, bytes]]:
    """16-byte keys, joined, by role: of the word with each place open, of its distinct deletions, of the word itself.

    How a key is hashed depends on the length of what it stands for, so that a word and
    a deletion of a longer one meet.
    """
    n = len(word)
    if n <= LONG:
        yield OPEN, b"".join([_digest(f"{word[:i]}*{word[i + 1:]}") for i in range(n)])
        yield ITSELF, _digest(word)
    if n <= LONG + 1:
        yield DELETED, b"".join([_digest(word[:i] + word[i + 1 :]) for i in range(n) if i + 1 == n or word[i] != word[i + 1]])
    if n > LONG:
        for role, found in _long_keys(word):
            if role != DELETED or n > LONG + 1:
                yield role, found


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key: list[bytes] = []
    told: list[tuple[int, int, int]] = []  # number, role, rows

    def out() -> pa.RecordBatch:
        both = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
        ids, roles, rows = (np.array(c) for c in zip(*told))
        made = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids, rows)), pa.array(np.repeat(roles, rows).astype(np.int8))]
        key.clear()
        told.clear()
        return pa.RecordBatch.from_arrays(made, names=["k1", "k2", "id", "role"])

    rows = 0
    for batch in batches:
        for word, i in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
            for role, found in keys(word):
                if role == DELETED and len(word) == LEAST:
                    continue
                key.append(found)
                told.append((i, role, len(found) // 16))
                rows += len(found) // 16
                if rows > 100_000:
                    yield out()
                    rows = 0
    if told:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of words(id, word) that have a near word: how many, and the least number among them."""
    rows = words.select("id", "word").mapInArrow(_memberships, "k1 long, k2 long, id long, role tinyint")
    group = Window.partitionBy("k1", "k2")
    members = F.when(F.col("role") < ITSELF, F.col("id"))
    told = rows.select(
        "id",
        "role",
        F.count(members).over(group).alias("size"),
        F.min(members).over(group).alias("first"),
        F.nth_value(members, 2, ignoreNulls=True).over(group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
        F.max(F.when(F.col("role") == ITSELF, F.col("id"))).over(group).alias("itself"),
    )
    is_open, deleted = F.col("role") == OPEN, F.col("role") == DELETED
    near = F.when(is_open, F.col("size") - 1).when(deleted, F.col("itself").isNotNull().cast("long")).otherwise(F.col("size"))
    best = F.when(is_open, F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first"))).when(deleted, F.col("itself")).otherwise(F.col("first"))
    return told.select("id", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of forms(id, form): where following forms ends.

    Each round doubles the way that a row has gone. A form is TIMES as frequent as its word, so ways are
    as long as the logarithm of the largest count, and rounds as the logarithm of that.
    """
    ways = staged(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        further = ways.select(F.col("id").alias("root"), F.col("root").alias("on"))
        step = staged(ways.join(further, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("went")), "ways")
        ways = step.select("id", "root")
        if step.filter("went").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word
    with the largest n (ties: the smallest in code-point order) if it is at least TIMES as frequent,
    root where following forms ends (the word itself without one). Null, empty and blank texts have no
    words; a null id counts as an empty one; repeated rows count again; other columns are not read; very long
    texts are read in slices and words of any length take part; an empty table gives no rows.
    """
    words = vocabulary(docs, text_col, id_col)
    # A form's n follows from its number, so the numbers that are somebody's best are joined, not pairs.
    near = staged(near_words(words), "near")
    best = near.join(words.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n")), "best")
    known = words.join(best, "id", "left")
    formed = F.col("best_n") >= TIMES * F.col("n")
    known = staged(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form_id"), F.when(formed, F.col("best_word")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "known")
    roots = _roots(known.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
