"""Quality rules by compression bands.

zstandard is run over the whole UTF-8 text and over fixed chunks of it. Natural prose
compresses within a band that depends on its length; repeated text lies above the band,
random or encoded text below. A text is rejected when its own ratio leaves the band of its
length, or when more than `chunk_share` of its bytes lie in chunks that leave theirs.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pieces, slices, texts_of
from .memo import release

#: (bytes below which the row holds, least ratio, greatest ratio). Short texts hardly
#: compress, long ones share more of their history; ratios outside are not those of prose.
BANDS = (
    (128, 0.0, 2.4),
    (256, 0.9, 2.6),
    (512, 1.1, 2.8),
    (1024, 1.2, 3.0),
    (4096, 1.35, 3.4),
    (16384, 1.45, 4.0),
    (1 << 62, 1.5, 5.0),
)
CHUNK = 4096
CHUNK_SHARE = 0.3
LEVEL = 3
#: Bytes of a text from which its windows are numbers, not tuples of words.
LONG = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0d]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, whole_ratio double, bad_chunk_share double"
)


def _band(n: int, bands: tuple) -> tuple[float, float]:
    for below, low, high in bands:
        if n < below:
            return low, high
    return bands[-1][1:]


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    ids: dict = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, len(windows))
    again = np.bincount(at)[at] > 1
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : k + len(windows)] |= again
    return int(marked.sum())


def _runs_again(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.append(ordered[1:] == ordered[:-1], False)
    same[1:] |= same[:-1]
    out = np.zeros(len(key), bool)
    out[order[same]] = True
    return out


def long_repeat_words(data: bytes) -> tuple[int, int]:
    """(words, repeat_words) of a long UTF-8 text: a number for each word, and windows as numbers of pairs and words."""
    ids: dict[bytes, int] = {}
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in (part.split() for part in slices(data, _SPACE))]
    at = np.concatenate(parts)
    n, kinds = len(at), len(ids)
    if n < 4:
        return n, 0
    pair = np.unique(at[:-1] * kinds + at[1:], return_inverse=True)[1]
    again = _runs_again(pair[:-1] * kinds + at[2:])
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : k + len(again)] |= again
    return n, int(marked.sum())


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    lines = 0
    for line in io.BytesIO(data):
        if line.strip():
            lines += 1
            seen.add(line.rstrip(b"\n"))
    return lines - len(seen)


def measure(text: str, squeeze, bands=BANDS, chunk=CHUNK, chunk_share=CHUNK_SHARE) -> tuple:
    """The counts and the verdict of one text, in the order of SCHEMA after doc_id."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) > LONG:
        n, repeated = long_repeat_words(data)
    else:
        words = data.split()
        n, repeated = len(words), repeat_words(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    failed = n < 50 or 100 * repeated > 50 * n
    ratio, share = 0.0, 0.0
    if data:
        ratio = len(data) / len(squeeze(data))
        bad = 0
        for i in range(0, len(data), chunk):
            part = data[i : i + chunk]
            low, high = _band(len(part), bands)
            if not low <= len(part) / len(squeeze(part)) <= high:
                bad += len(part)
        share = bad / len(data)
    low, high = _band(len(data), bands)
    kept = not failed and low <= ratio <= high and share <= chunk_share
    return n, word_chars, symbols, dup_lines(data), repeated, failed, kept, ratio, share


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    bands: tuple = BANDS,
    chunk: int = CHUNK,
    chunk_share: float = CHUNK_SHARE,
    level: int = LEVEL,
) -> DataFrame:
    """One row per document: word and repetition counts, the ratios and `kept`.

    Null texts count as empty, have no words and fail. Repeated rows, and texts that tie in all measures, give a row each; a null id
    stays null; other columns are not read. An empty table gives no rows. Narrow: no shuffle. A very long text is
    measured whole by one task, in some 15 bytes a byte at most beside it (words as numbers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        release()
        squeeze = zstandard.ZstdCompressor(level=level).compress
        for batch in pieces(batches, "text"):
            rows = [measure(t, squeeze, bands, chunk, chunk_share) for t in texts_of(batch, "text")]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in SCHEMA.split(",")])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with all their columns.

    The verdict is computed beside the row itself (no join back), so repeated rows, ties and null ids
    are safe, and columns of any other name pass through. Null and empty texts fail the base rule of 50
    words and go; an empty table gives an empty one; very long texts are measured whole. Needs a column `text`.
    """
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        release()
        squeeze = zstandard.ZstdCompressor(level=settings.get("level", LEVEL)).compress
        given = {k: v for k, v in settings.items() if k != "level"}
        for batch in pieces(batches, "text"):
            kept = [measure(t, squeeze, **given)[6] for t in texts_of(batch, "text")]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema).select(*columns)
