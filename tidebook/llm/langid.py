"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled, so text that switches language is followed word by word:
affixes, character n-grams and a lexicon score a word, learned transitions tie neighbours, and
forward-backward gives each word's label probabilities. A document's language is the one with
the greatest mean probability over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import crc_bucket, drawn_windows, n_windows, pieces, texts_of
from .memo import Numbers, kept

#: Bounds of the training sample, drawn from all windows of so many characters of the labelled
#: texts: about so many windows of each language, and so many of all.
SAMPLE_PER_LABEL, SAMPLE = 250, 20_000
SAMPLE_CHARS = 2000
#: Training sequences, each of one to three segments of sampled documents, and words a segment.
SEQUENCES = 2400
SEGMENT = 24
LEXICON = 200
WIDTH = 1 << 16
ROUNDS = 50
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"

#: Longer runs of letters, as of scripts without spaces, are cut into words of so many letters.
LETTERS = re.compile(r"[^\W\d_]{1,24}")


def words_in(text: str) -> list[str]:
    """Words of runs of letters, in lower case. (Numerals such as one half alone are no word.)"""
    words = LETTERS.findall(text.lower())
    return words if not words or words[0].isalpha() else [w for w in words if any(map(str.isalpha, w))]


def word_features(lexicon: dict[str, str]):
    """A function word -> feature strings."""

    def features(w: str) -> list[str]:
        b = f"^{w}$"
        out = [f"p{k}{b[:k]}" for k in (2, 3, 4)] + [f"s{k}{b[-k:]}" for k in (2, 3, 4)]
        out += [f"g{b[i : i + k]}" for k in (2, 3) for i in range(len(b) - k + 1)]
        out.append(f"l{lexicon.get(w, '-')}")
        if w in lexicon:
            out.append(f"w{w}")
        return out

    return features


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.lexicon, self.weights, self.moves = labels, lexicon, weights, moves


def fit(samples: list[tuple[str, str]], width: int = WIDTH, rounds: int = ROUNDS, sequences: int = SEQUENCES, seed: int = 7) -> Model | None:
    """Train on (language, text) samples; None if no sample has a word.

    Training sequences join segments of different samples, so that switches are seen too.
    """
    by_label: dict[str, list[list[str]]] = {}
    for label, text in sorted(samples):
        words = words_in(text)
        if words:
            by_label.setdefault(label, []).extend(words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT))
    labels = sorted(by_label)
    if not labels:
        return None
    lexicon: dict[str, str] = {}
    for label in labels:
        for w, _ in sorted(Counter(w for s in by_label[label] for w in s).items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, "") + label + ";"
    rng = np.random.default_rng(seed)
    words: list[str] = []
    gold: list[int] = []
    lengths: list[int] = []
    for _ in range(sequences):
        before = len(words)
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(len(labels)))
            segments = by_label[labels[k]]
            segment = segments[int(rng.integers(len(segments)))]
            words += segment
            gold += [k] * len(segment)
        lengths.append(len(words) - before)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    features = word_features(lexicon)
    views = [(crf.Features([crf.hashed(features(w), width) for w in number]), np.array([number[w] for w in words]))]
    weights, moves = crf.train(views, np.array(gold), np.array(lengths), len(labels), width, rounds)
    return Model(labels, lexicon, weights.astype(np.float32), moves)


class Reader:
    """The numbers of the words of whole texts, with the words' scores."""

    def __init__(self, model: Model):
        self.scored = crf.Scored([word_features(model.lexicon)], model.weights)
        self.numbers = Numbers(words_in, self.scored.learn)


def training_sample(docs: DataFrame, fold: F.Column, text_col: str, label_col: str, id_col: str, per_label: int, chars: int, sample: int) -> list[tuple[str, str]]:
    """About `per_label` windows of each label where `fold` holds, at most twice `sample` of all.

    A row for each label comes to the driver to tell the labels' shares.
    """
    label = F.col(label_col).cast("string")
    usable = docs.filter(fold & label.isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(label.alias("label")).agg(F.sum(n_windows(F.col(text_col), chars)).alias("n")).collect()}
    if not counts:
        return []
    each = max(1, min(per_label, sample // len(counts)))
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, each / n))])[label]
    rows = drawn_windows(usable, id_col, F.col(text_col), chars, share, 2 * each * len(counts), 11, label.alias("label"))
    return [(r[0], r[1]) for r in rows]


def identify(docs: DataFrame, folds: int = 5, held: int = 0, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang", per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS, sample: int = SAMPLE) -> DataFrame:
    """One row per document: held_out, lang_pred, score, n_words and n_switches.

    The model learns every label from a bounded sample (per_label, chars, sample) of the documents
    that are not held out. A text that is null or has no letter gets `und` and score 0; so does every
    text if nothing can be learned from. All letters are read; n_words counts runs of more than 24
    letters as several words. Repeated rows give a row each, equal probabilities go to the first
    label by name, null ids stay null, other columns are not read, and an empty table gives no rows.
    A text is labelled by one task, in time and memory proportional to its words.
    """
    held_out = crc_bucket(id_col, folds) == held
    model = fit(training_sample(docs, ~held_out, text_col, label_col, id_col, per_label, chars, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = model and kept("langid", key, lambda: Reader(model))
        for batch in pieces(batches, "text", 6 << 20):
            n = batch.num_rows
            best, score, switches, lengths = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if model:
                flat, lengths = reader.numbers.batch(texts_of(batch, "text"))
                gamma = crf.forward_backward(reader.scored.table[flat], lengths, model.moves)
                some = np.flatnonzero(lengths)
                if len(some):
                    starts = (np.cumsum(lengths) - lengths)[some]
                    mean = np.add.reduceat(gamma, starts, axis=0) / lengths[some, None]
                    best[some], score[some] = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
                    label = gamma.argmax(axis=1)
                    turn = np.concatenate([[0], (label[1:] != label[:-1]).astype(np.int64)])
                    turn[starts] = 0
                    switches[some] = np.add.reduceat(turn, starts)
            names = np.array([*(model.labels if model else []), "und"], object)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(lengths), pa.array(switches)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, SCHEMA)
