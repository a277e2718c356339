"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags tokens as the begin of a secret, inside or outside, from a token's shape, its
neighbours and features of the file, decoded by Viterbi. Spans it finds are added to those of
the patterns, which always stay, unless the patterns' spans cover them. They may overlap those.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import drawn_windows, n_windows, pieces, texts_of
from .memo import Numbers, kept

# The base patterns and their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Bounds of the training sample: so many windows of so many characters, drawn from all windows of all texts.
SAMPLE, SAMPLE_CHARS = 1500, 1200
WIDTH, ROUNDS = 1 << 14, 50
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

TOKEN = re.compile(r"""[^\s:="'(),;<>\[\]{}|]+|[:="'(),;<>\[\]{}|]""")
CUES = re.compile(r"pass|pwd|secret|token|api|key|auth|bearer|cred|private|login|akia|sk_|ghp_")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def values(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the secret values alone, without the name that they are assigned to."""
    out = []
    for start, kind, end in spans:
        m = ASSIGN.match(text, start) if kind == 0 else None
        out.append(m.span(2) if m else (start, end))
    return out


WORD = re.compile(r"([^\W\d_]{1,19})([^\w\s]{0,4})")


def _plain(w: str) -> tuple[int, str, str] | None:
    """(length, case, marks behind) of a short word of letters that holds no cue, else None."""
    found = WORD.fullmatch(w)
    if not found or CUES.search(w.lower()):
        return None
    letters, marks = found.groups()
    return len(letters), "a" if letters.islower() else "A" if letters.isupper() else "Aa" if letters[1:].islower() else "aA", marks


def token_key(w: str) -> object:
    """Equal keys have equal features: plain words share theirs by length, case and marks."""
    return _plain(w) or w


def token_features(w: str) -> list[str]:
    """Shape of a token."""
    if plain := _plain(w):
        n, case, marks = plain
        return ["bias", f"n{n}", f"word{case}", f"word{case}{n // 8}", f"behind{marks}"]
    n = len(w)
    low = w.lower()
    digits = sum(map(str.isdigit, w))
    upper = sum(map(str.isupper, w))
    alpha = sum(map(str.isalpha, w))
    other = n - digits - alpha
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(w).values())
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(w, w[1:]))
    classes = "a" * (alpha > upper) + "A" * bool(upper) + "0" * bool(digits) + "-" * bool(other)
    dense = 10 * turns // n
    out = ["bias", f"c{classes}", f"c{classes}r{dense}", f"l{min(12, n // 4)}", f"d{4 * digits // n}", f"o{min(4, other)}", f"r{dense}e{round(entropy)}"]
    # What grows is told by the steps that it reached, so that lengths not met in training are known by shorter ones.
    out += [f"n>{k}" for k in (8, 12, 16, 20, 24, 32, 48, 64) if n > k] + [f"t>{k}" for k in (1, 3, 5, 8, 12, 20) if turns > k]
    out += [f"e>{k}" for k in (2.5, 3, 3.5, 4, 4.5, 5) if entropy > k] + [f"n>{k}r{dense}" for k in (8, 16, 24) if n > k]
    if n >= 16 and not set(low) - set("0123456789abcdef"):
        out.append(f"hex{digits != n}")
    if (found := CUES.search(low)) and n < 24:
        out.append(f"cue{found[0]}")
    if n == 1 and not w.isalnum():
        out.append(f"is{w}")
    if digits == n:
        out.append(f"num{min(n, 20)}")
    return out


def file_features(text: str) -> list[str]:
    n = len(text) + 1
    return [f"f={min(3, text.count('=') * 400 // n)}", f"fl{min(3, text.count(chr(10)) * 60 // n)}", f"fb{min(2, (text.count('{') + text.count(';')) * 200 // n)}"]


def side(prefix: str):
    return lambda w: [prefix + f for f in token_features(w)]


#: Names that secrets are given in training, and places of a value.
NAMES = "password passwd secret token api_key client_secret auth access_key private_key credential bearer pwd signing_key"
FRAMES = ('{n} = "{v}"', "{n}: {v}", "{n}={v}", "'{n}': '{v}'", "{n} {v}", "export {n}={v}", "--{n} {v}", "{n}:`{v}`", "({n}, '{v}')", '<{n} value="{v}">', "{n}: Bearer {v}", "use {v} as {n}", "with {v}", "{n} := {v};")


def _drawn(rng: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def planted(rng: random.Random) -> tuple[str, str]:
    """A made-up secret with the words around it, for training.

    Its form is put together at random: a prefix, one to five random parts of one alphabet, joined
    by a mark, and padding; or a short password of letters, digits and a mark.
    """
    word, hex_ = string.ascii_letters + string.digits, "0123456789abcdef"
    if rng.random() < 0.2:
        value = _drawn(rng, string.ascii_letters, 3, 6) + _drawn(rng, string.digits, 2, 4) + rng.choice("!#$%&*_-@^") + _drawn(rng, word, 2, 8)
    else:
        letters = rng.choice([hex_, hex_, word, word, word, word + "+/", word + "-_", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters])
        parts = rng.choice([1, 1, 1, 2, 3, 4, 5])
        body = rng.choice("-._").join(_drawn(rng, letters, 4 if parts > 1 else 18, 44 if parts < 4 else 14) for _ in range(parts))
        while len(body) < 20:
            body += rng.choice(letters)
        prefix = rng.choice(["", "", "AKIA", _drawn(rng, string.ascii_letters, 2, 5) + rng.choice(["_", "-", ".", ""])])
        value = prefix + body + rng.choice(["", "", "", "="])
    name = rng.choice(NAMES.split())
    cap = "".join(x.title() for x in name.split("_"))
    name = rng.choice([name, name, name.upper(), name.replace("_", "-"), cap, cap[0].lower() + cap[1:], name.replace("_", "")])
    return rng.choice(FRAMES).format(n=name, v=value), value


def harmless(rng: random.Random) -> str:
    """What looks a little like a secret and is none, for training: addresses, paths, names, times, numbers, versions."""
    some = lambda joint: joint.join(_drawn(rng, string.ascii_lowercase, 3, 9) for _ in range(rng.randint(2, 6)))
    return rng.choice(
        [
            lambda: f"https://{some('.')}/{some('/')}{rng.choice(['', '.html', '?page=2'])}",
            lambda: f"/{some('/')}/{some('_')}.py",
            lambda: some("_"),
            lambda: some("-"),
            lambda: some("_").title().replace("_", ""),
            lambda: f"{some('.')}@{some('-')}.com",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00Z",
            lambda: _drawn(rng, string.digits, 5, 19),
            lambda: f"{some(' ')}={rng.randint(0, 9999)}",
            lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}-{_drawn(rng, string.ascii_lowercase, 2, 5)}{rng.randint(0, 9)}",
            lambda: f"{rng.choice(NAMES.split())} {some(' ')}",
        ]
    )()


def labelled(texts: list[str], seed: int = 5) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Windows of sampled texts with their secret values: base matches, and up to three planted ones in a third.

    Up to three harmless look-alikes are put into another third.
    """
    rng = random.Random(seed)
    out, golds = [], []
    for text in texts:
        draw, words, gold = rng.randrange(3), text.split(" "), []
        for _ in range(rng.randint(1, 3) if draw < 2 else 0):
            words.insert(rng.randrange(len(words) + 1), planted(rng) if draw else harmless(rng))
        parts, at = [], 0
        for w in words:
            said, value = w if isinstance(w, tuple) else (w, "")
            if value:
                start = at + said.index(value)
                gold.append((start, start + len(value)))
            parts.append(said)
            at += len(said) + 1
        text = " ".join(parts)
        out.append(text)
        golds.append(gold + values(text, base_spans(text)))
    return out, golds


class Model:
    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves


def fit(texts: list[str], width: int = WIDTH, rounds: int = ROUNDS) -> Model | None:
    """Train on windows of texts; None if there is none with a token."""
    texts, golds = labelled(sorted(t for t in texts if t.strip()))
    words, gold, lengths, files, file_at = [], [], [], [], []
    for k, (text, spans) in enumerate(zip(texts, golds)):
        before = len(words)
        last = None
        for m in TOKEN.finditer(text):
            inside = next((s for s in spans if s[0] <= m.start() < s[1]), None)
            gold.append(OUTSIDE if inside is None else INSIDE if inside == last else BEGIN)
            last = inside
            words.append(m[0])
        lengths.append(len(words) - before)
        files.append(crf.hashed(file_features(text), width))
        file_at += [k] * (len(words) - before)
    if not words:
        return None
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([number[w] for w in words])
    prior, after = np.concatenate([[-1], at[:-1]]), np.concatenate([at[1:], [-1]])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    some = np.array(lengths) > 0
    prior[starts[some]] = -1
    after[ends[some] - 1] = -1
    views = [(crf.Features([crf.hashed(side(p)(w), width) for w in number]), x) for p, x in (("s", at), ("p", prior), ("n", after))]
    views.append((crf.Features(files), np.array(file_at)))
    weights, moves = crf.train(views, np.array(gold), np.array(lengths), 3, width, rounds)
    moves[OUTSIDE, INSIDE] -= 20.0  # no secret begins inside
    return Model(weights.astype(np.float32), moves)


def surely_outside(scores: np.ndarray, lasts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that are outside in every best labelling. lasts: the places of the sequences' last tokens.

    Were such a token in a secret, calling it outside, and the next token, if it is inside, a beginning, would score more:
    the token's own margin is more than all that the moves around it and the next token's change can take away.
    """
    none, labels = -1, (OUTSIDE, BEGIN, INSIDE)
    move = lambda a, b: 0.0 if none in (a, b) else float(moves[a, b])
    most = -np.inf
    for a, y, c in product((none, *labels), (BEGIN, INSIDE), (none, *labels)):
        changed = BEGIN if c == INSIDE else c
        for d in (none,) if c == none else (none, *labels):
            most = max(most, move(a, y) + move(y, c) + move(c, d) - move(a, OUTSIDE) - move(OUTSIDE, changed) - move(changed, d))
    margin = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE])
    change = np.zeros(len(scores))
    change[:-1] = np.maximum(scores[1:, INSIDE] - scores[1:, BEGIN], 0.0)
    change[lasts] = 0.0
    return margin > most + change + 1e-6


class Tagger:
    """Spans that the field finds in whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.scored = crf.Scored([side(p) for p in "spn"], model.weights, token_key)
        self.numbers = Numbers(TOKEN.findall, self.scored.learn)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        flat, lengths = self.numbers.batch(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(flat):
            return out
        own, prior, after = np.split(self.scored.table, 3, axis=1)
        scores = own[flat]
        ends = np.cumsum(lengths)
        firsts, lasts = (ends - lengths)[lengths > 0], ends[lengths > 0] - 1
        left, right = prior[flat[:-1]], after[flat[1:]]
        left[firsts[1:] - 1] = 0
        right[lasts[:-1]] = 0
        scores[1:] += left
        scores[:-1] += right
        width, moves = len(self.model.weights), self.model.moves
        some = np.flatnonzero(lengths)
        scores += np.repeat(np.array([self.model.weights[crf.hashed(file_features(texts[k]), width)].sum(axis=0) for k in some]), lengths[some], axis=0)
        # Only stretches between tokens that are outside in every best labelling are decoded.
        sure = surely_outside(scores, lasts, moves)
        tags = np.zeros(len(flat), np.int8)
        needed = ~sure
        inner = np.ones(len(flat), bool)
        inner[firsts] = False  # tokens that have one before them in their text
        needed[:-1] |= ~sure[1:] & inner[1:]
        needed[1:] |= ~sure[:-1] & inner[1:]
        at = np.flatnonzero(needed)
        if not len(at):
            return out
        stretch = scores[at]
        stretch[sure[at], BEGIN] = stretch[sure[at], INSIDE] = -1e9
        begins = np.append(True, (np.diff(at) > 1) | ~inner[at[1:]])
        tags[at] = crf.viterbi(stretch, np.diff(np.append(np.flatnonzero(begins), len(at))), moves)
        for k in np.flatnonzero(np.bincount(np.repeat(np.arange(len(texts)), lengths), tags != OUTSIDE, len(texts))).tolist():
            own_tags = tags[ends[k] - lengths[k] : ends[k]].tolist()
            for m, tag in zip(TOKEN.finditer(texts[k]), own_tags):
                start, end = m.span()
                if tag == BEGIN or (tag == INSIDE and not out[k]):
                    out[k].append((start, end))
                elif tag == INSIDE:
                    out[k][-1] = (out[k][-1][0], end)
        return out


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover without a break."""
    starts, ends = [], []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def scan(text: str, extra: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the field's spans that reach beyond all base spans (kind 3), whole."""
    base = base_spans(text)
    starts, ends = merged(base)

    def covered(s: int, e: int) -> bool:
        k = bisect_right(starts, s) - 1
        return k >= 0 and e <= ends[k]

    return base, sorted(base + [(s, 3, e) for s, e in extra if not covered(s, e)])


def told(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "crf")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def trained(docs: DataFrame, text_col: str, id_col: str, sample: int, chars: int):
    """A broadcast model from a bounded sample of windows."""
    text = F.col(text_col).cast("string")
    n = docs.filter(text.isNotNull()).agg(F.sum(n_windows(text, chars))).first()[0] or 0
    rows = drawn_windows(docs, id_col, text, chars, F.lit(min(1.0, 2 * sample / max(1, n))), sample, 21)
    return docs.sparkSession.sparkContext.broadcast(fit([r[0] for r in rows]))


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans.

    Null texts count as empty and have no spans; the digest is then that of the empty text.
    Repeated rows give a row each, null ids stay null, other columns are not read, an empty table
    gives no rows. Spans that begin together are ordered by kind; labels of equal score go to
    outside before begin before inside. A text is scanned by one task, in time that grows with its
    length (and the logarithm of its spans).
    """
    shared, key = trained(docs.select(id_col, text_col), text_col, id_col, sample, chars), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept("secrets", key, lambda: Tagger(shared.value)) if shared.value else None
        for batch in pieces(batches, "text", 3 << 20):
            texts = texts_of(batch, "text")
            rows = []
            for text, extra in zip(texts, tagger.spans(texts) if tagger else [[]] * len(texts)):
                base, every = scan(text, extra)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(every), len(every) - len(base)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """docs with the secret values in `text` replaced by a mark; the name of an assignment stays.

    Values that overlap, or tie in where they begin, are replaced as one, by their union. A very long text is decoded whole by one task, stretch by stretch. All other columns, of any name, stay as
    they are; null and empty texts stay what they are. Rows repeated stay repeated and are redacted
    alike; an empty table gives an empty one. Needs columns text and doc_id (which may be null).
    """
    shared, key = trained(docs.select("doc_id", "text"), "text", "doc_id", sample, chars), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept("secrets", key, lambda: Tagger(shared.value)) if shared.value else None
        for batch in pieces(batches, "text", 3 << 20):
            given, texts = batch.column("text").to_pylist(), texts_of(batch, "text")
            out = []
            for old, text, extra in zip(given, texts, tagger.spans(texts) if tagger else [[]] * len(texts)):
                _, every = scan(text, extra)
                at, parts = 0, []
                for start, end in sorted(values(text, every)):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append(old if old is None else "".join([*parts, text[at:]]))
            columns = [pa.array(out, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
