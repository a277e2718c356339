"""License scans by patience alignment.

A text is read near its seed words. There it is aligned with each template, from each place that
the seed word has in the template to both sides: words that occur once in both are anchors, the
longest increasing subsequence of them is kept, and the gaps between are aligned in the same way.
The share of a template's words that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts_of
from .license_texts import SEEDS, TEMPLATES

#: (words of a template up to which the row holds, least coverage). One word tells short notices apart.
LEAST = ((8, 1.0), (25, 0.9), (1 << 30, 0.7))
SCHEMA = "doc_id long, license string, coverage double, start long, end long, template_words long, matched_words long"

WORD = re.compile(r"[^\W_]+(?:[.'+-][^\W_]+)*")
SEED = re.compile("|".join(SEEDS))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ordered by first) that increases in second, by patience piles."""
    tops: list[int] = []
    on: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = on[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            on.append(i)
        else:
            tops[k], on[k] = y, i
    out = []
    i = on[-1] if on else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a longest common subsequence; of several an early one."""
    kept_a, kept_b = (set(x) for x in (a, b))
    p, q = [i for i, w in enumerate(a) if w in kept_b], [j for j, w in enumerate(b) if w in kept_a]
    size = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[p[i]] == b[q[j]] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(p) and j < len(q) and size[i][j]:
        if a[p[i]] == b[q[j]]:
            out.append((p[i], q[j]))
            i, j = i + 1, j + 1
        elif size[i][j + 1] == size[i][j]:
            j += 1
        else:
            i += 1
    return out


def patience(a: list[str], b: list[str], open_: bool = False) -> list[tuple[int, int]]:
    """Aligned places of a and b, in order; gaps without words that occur once by their longest common subsequence.

    With open_, a may go on with other text behind b's words: its end is no place to begin from.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1] and not (open_ and m == len(a)):
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in place])
        if not anchors:
            out += [(i + x, j + y) for x, y in common(a[i:m], b[j:n])]
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, license_: str, text: str):
        self.license, self.words = license_, WORD.findall(text.lower())
        self.seeds = {w for w in self.words if SEED.match(w)}
        self.counts = Counter(self.words)
        self.where = {w: [o for o, x in enumerate(self.words) if x == w] for w in self.seeds}
        #: The fewest first and last words that come once in the template.
        self.head, self.tail = self._once(self.words), self._once(self.words[::-1])[::-1]
        self.least = next(share for upto, share in LEAST if len(self.words) <= upto)

    @staticmethod
    def _once(words: list[str]) -> list[str]:
        return next(words[:k] for k in range(1, len(words) + 1) if sum(words[i : i + k] == words[:k] for i in range(len(words))) == 1)

    def places(self, words: list[str], at: int, low: int, high: int) -> Iterator[tuple[float, int, int, int]]:
        """(coverage, first word, last word, matched) where words[low:high] cover the template, with word `at` at each of its places."""
        n = len(self.words)
        slack = max(3, n // 4)
        head, tail = self.head, self.tail
        for o in self.where[words[at]]:
            start, stop = max(low, at - o - slack), min(high, at - o + n + slack)
            # The next copy begins where the template's first words come again; the last one ends at its last words.
            stop = next((k for k in range(at + 1, stop) if words[k] == head[0] and words[k : k + len(head)] == head), stop)
            start = next((k + 1 for k in range(at - 1, start - 1, -1) if words[k] == tail[-1] and words[max(0, k - len(tail) + 1) : k + 1] == tail), start)
            present = set(words[start:stop])
            if sum(c for w, c in self.counts.items() if w in present) < self.least * n:
                continue  # even all words that are there would not cover it
            left = patience(words[start:at][::-1], self.words[:o][::-1], True)
            right = patience(words[at + 1 : stop], self.words[o + 1 :], True)
            if found := self._run([*(at - 1 - k for k, _ in left[::-1]), at, *(at + 1 + k for k, _ in right)]):
                yield found

    def near(self, words: list[str], at: int, low: int, high: int) -> Iterator[tuple[float, int, int, int]]:
        """The same for the words around `at`, wherever that word may lie in the template."""
        n = len(self.words)
        low, high = max(low, at - n - n // 2), min(high, at + n + n // 2 + 1)
        window = words[low:high]
        present = set(window)
        if sum(c for w, c in self.counts.items() if w in present) >= self.least * n and (found := self._run([low + k for k, _ in patience(window, self.words)])):
            yield found

    def _run(self, aligned: list[int]) -> tuple[float, int, int, int] | None:
        # Words aligned far from the rest are chance; the run around the most words stays.
        n = len(self.words)
        runs: list[list[int]] = []
        for k in aligned:
            if runs and k - runs[-1][-1] <= max(3, n // 4):
                runs[-1].append(k)
            else:
                runs.append([k])
        if not runs:
            return None
        best = max(runs, key=len)
        coverage = len(best) / n
        return (coverage, best[0], best[-1], len(best)) if coverage >= self.least else None

    def match(self, words: list[str], at: int, low: int, high: int) -> tuple[float, int, int, int] | None:
        """The best place within words[low:high] that the template covers near word `at`; the shortest of several."""
        found = list(self.places(words, at, low, high)) or list(self.near(words, at, low, high))
        return min(found, key=lambda m: (-m[0], m[2] - m[1], m)) if found else None


def scan(text: str, templates: list[Template]) -> list[tuple[str, float, int, int, int, int]]:
    """(license, coverage, start, end, template words, matched words) of a text, by start.

    Of templates that match at one place the one with the most matched words times coverage is
    told, then the first listed; places don't overlap.
    """
    low = text.lower()
    if not SEED.search(low):
        return []
    if len(low) != len(text):  # letters whose lower case is longer; places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[s:e] for s, e in spans]
    found: list[tuple[float, int, int, int, tuple[float, int, int, int]]] = []

    def look(at: int, k: int, low: int, high: int) -> tuple[float, int, int, int] | None:
        if m := templates[k].match(words, at, low, high):
            heappush(found, (-m[0] * m[3], k, m[2] - m[1], at, m))
        return m

    ends = [-1] * len(templates)  # last word of the latest copy of a template that has its words alone
    for at, w in enumerate(words):
        if SEED.match(w):
            for k, t in enumerate(templates):
                if w in t.seeds and at > ends[k] and (m := look(at, k, 0, len(words))) and m[3] == len(t.words) == m[2] - m[1] + 1:
                    ends[k] = m[2]
    out, firsts, lasts = [], [], []  # places taken, in order
    while found:
        _, k, _, at, (coverage, first, last, matched) = heappop(found)
        i = bisect_left(lasts, first)
        if i == len(firsts) or firsts[i] > last:
            firsts.insert(i, first)
            lasts.insert(i, last)
            out.append((templates[k].license, coverage, spans[first][0], spans[last][1], len(templates[k].words), matched))
            continue
        i = bisect_left(lasts, at)
        if i == len(firsts) or firsts[i] > at:  # what the places taken leave around the seed
            look(at, k, lasts[i - 1] + 1 if i else 0, firsts[i] if i < len(firsts) else len(words))
    return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per place of a document that a license template covers.

    start and end are code points, end exclusive. Case and punctuation don't count. Every copy of a
    notice gives a row; places of one text don't overlap. Of templates that match at one place the one
    with the most matched words times coverage is told, of equal ones the first listed, then the
    shortest place. Null and empty texts and texts without a license give no row; repeated rows give
    rows each, a null id stays null, other columns are not read, an empty table gives no rows. A text
    is scanned by one task: its words are read once, and each seed word ("license", ...) costs about
    three template lengths of words for each template that has it. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(*t) for t in templates]
        for batch in pieces(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            rows = [(key, *row) for key, text in zip(keys, texts_of(batch, "text")) for row in scan(text, made)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
