"""Ranked search, spelling variants and SimHash against brute force, and on hard rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from rows import SCHEMA, hard_rows, prose, row

from tidebook.llm import lexical, simhash, spelling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VERY_LONG = "lorem ipsum dolor " * 300_000  # 5.4 million characters


def many(n, seed=7):
    """Prose with copies, near copies, misspelt words and ties."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = prose(rng.randrange(n // 2) + 100, rng.randrange(1, 90)).split()
        if k % 3 == 0 and words:
            i = rng.randrange(len(words))
            w = words[i]
            p = rng.randrange(len(w))
            words[i] = rng.choice([w[:p] + w[p + 1 :], w[:p] + "éx"[k % 2] + w[p:], w[:p] + "q" + w[p + 1 :]])
        out.append((rng.randrange(10 * n), " ".join(words)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# 11


def brute_search(docs, items, top):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    held = [(i, Counter(split(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    n_terms = sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in held:
            score = 0
            for w in set(split(text)) & set(c):
                m = 50 + 50 * c.total() * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("segment, at_once, top", [(16_384, 128, 50), (7, 2, 5), (70, 3, 1)])
def test_search_equals_scoring_every_document(spark, segment, at_once, top):
    docs = many(300)
    items = [(k, prose(k + 100, 12) + " Xyzzy, NAÏVE río") for k in range(7)] + [(90, ""), (91, None), (92, "zzz-none")]
    index = lexical.impact_index(frame(spark, docs), documents=segment)
    found = lexical.ranked_search(index, spark.createDataFrame(items, "item_id long, text string"), top=top, at_once=at_once)
    assert sorted(tuple(r) for r in found.collect()) == brute_search(docs, items, top)


def test_search_on_hard_rows(spark, hard, none):
    items = [(1, prose(1)), (2, "WORD token漢字 Ωμέγα 👍🏽"), (3, "é½ 漢字")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(tuple(r) for r in lexical.rank_documents(hard, asked).collect())
    assert rows == brute_search([(r[0], r[1]) for r in hard_rows()], items, 50)
    assert lexical.rank_documents(none, asked).count() == 0
    assert lexical.rank_documents(hard, asked.limit(0)).count() == 0


def test_counts_are_packed_by_row():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 9, 300)
    tf = rng.choice([1, 2, 255, 256, 70_000, 3_000_000_000], int(rows.sum()), p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02])
    packed = lexical._counts(tf, np.concatenate([[0], np.cumsum(rows)]))
    assert lexical._flat_counts(packed, rows).tolist() == tf.tolist()
    assert sum(len(x) for x in packed.to_pylist()) < 4 * len(tf)


def test_bitwise_addition_and_descent():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 200):
        words = (n + 63) // 64
        total, want = [], np.zeros(n, np.int64)
        for _ in range(20):
            at = np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False)).astype(np.uint16)
            value = rng.integers(0, 1 << rng.integers(1, 36), len(at))
            if not value.any():
                continue
            want[at] += value
            held, bits = lexical.sliced(value, np.array([len(at)]))
            lexical.add_slices(total, lexical.bitmaps(at.tobytes(), int(bits[0]), held[0].as_py(), words))
        for k in (1, 3, 50):
            at, score = lexical.best(total, k)
            first = sorted((-s, i) for i, s in enumerate(want.tolist()) if s)[:k]
            assert sorted(zip((-score).tolist(), at.tolist())) == first


# 12


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling_equals_all_pairs(spark):
    docs = many(900, 5)
    # A chain of forms, ties, both kinds of edit, capitals beyond A-Z.
    docs += [(k, "chainword " * 3 + "chainwords " * 30 + "chainwordss " * 300 + "ÉCLAIRSS éclairss Éclairss " * 2) for k in range(5, 9)]
    want = brute_spelling(docs)
    got = sorted((tuple(r) for r in spelling.spelling_variants(frame(spark, docs)).collect()), key=str)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("n", [1023, 1024, 1025, 1026, 70_000])
def test_long_words_meet_as_short_ones_do(n):
    rng = random.Random(n)
    word = "".join(rng.choice("abc") for _ in range(n))
    at = n - 2 if n > 65_536 else n // 2
    shorter, changed = word[:at] + word[at + 1 :], word[:at] + "z" + word[at + 1 :]
    told = {w: {} for w in (word, shorter, changed)}
    for w in told:
        for role, found in spelling.keys(w):
            told[w].setdefault(role, []).extend(found[i : i + 16] for i in range(0, len(found), 16))
    for w, held in told.items():
        assert len(held[spelling.OPEN]) == len(set(held[spelling.OPEN])) == len(w)
        assert len(set(held[spelling.DELETED])) == len(held[spelling.DELETED]) == sum(a != b for a, b in zip(w, w[1:])) + 1
    assert told[shorter][spelling.ITSELF][0] in told[word][spelling.DELETED]
    assert told[shorter][spelling.ITSELF][0] in told[changed][spelling.DELETED]
    assert len(set(told[word][spelling.OPEN]) & set(told[changed][spelling.OPEN])) == 1
    assert not set(told[word][spelling.OPEN]) & set(told[word][spelling.DELETED])


def test_spelling_on_hard_rows(spark, hard, none):
    got = sorted((tuple(r) for r in spelling.spelling_variants(hard).collect()), key=str)
    assert got == brute_spelling([(r[0], r[1]) for r in hard_rows()])
    assert spelling.spelling_variants(none).count() == 0


def test_spelling_of_very_long_runs_is_linear(spark):
    run = "acgt" * 250_000
    began = time.time()
    got = {r["word"][:8]: r for r in spelling.spelling_variants(frame(spark, [(1, run + " " + run), (2, run[:-1]), (3, run[:-1] + "x " + run[:-1])])).collect()}
    assert len(got) == 1  # two words with one beginning: the last seen stands
    assert got["acgtacgt"]["n_near"] == 1
    assert time.time() - began < 60


# 13


def brute_fingerprint(text):
    words = (text or "").translate(ASCII).encode().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(docs, radius=3):
    prints = [brute_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, f"{p:016x}", least.get(top(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))), key=str)


@pytest.mark.parametrize("tile, parts", [(2048, None), (4, None), (3, 5)])
def test_simhash_equals_all_pairs(spark, tile, parts):
    docs = many(400, 11)
    docs += [(5000 + k, docs[0][1] + " more" * k) for k in range(30)]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(frame(spark, docs), tile=tile, parts=parts).collect()), key=str)
    assert got == brute_components(docs)


@pytest.mark.parametrize("tile, parts", [(2048, None), (16, None), (16, 6)])
def test_tiles_lose_no_link(spark, tile, parts):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for k in range(rng.randrange(8)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                p ^= 1 << b
            prints.add(p)
    base = rng.getrandbits(64)  # many that agree in most bits
    prints |= {base ^ (rng.getrandbits(12) << 7) for _ in range(300)}
    prints = sorted(prints)
    edges = simhash.near_fingerprints(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"), tile=tile, parts=parts)
    label = {p: p for p in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in edges.collect():
        a, b = top(r["a"] % (1 << 64)), top(r["b"] % (1 << 64))
        label[max(a, b)] = min(a, b)
    got = {p: top(p) for p in prints}
    label = {p: p for p in prints}
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = sorted((top(p), top(q)))
                label[b] = a
    assert got == {p: top(p) for p in prints}


def test_simhash_on_hard_rows(spark, hard, none):
    docs = [(r[0], r[1]) for r in hard_rows()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(hard).collect()), key=str)
    assert got == brute_components(docs)
    assert simhash.simhash_components(none).count() == 0


# all three


def test_clashing_names(spark):
    clash = spark.createDataFrame([row(k, prose(k % 3 + 1)) for k in range(20)], SCHEMA)
    for c in ("fp", "fingerprint", "component_id", "word", "n", "id", "term", "segment", "query", "DOC_TERM", "rank", "score", "bucket", "mask"):
        clash = clash.withColumn(c, clash["source"])
    asked = spark.createDataFrame([(1, prose(1), "a", 3)], "item_id long, text string, rank string, doc_id long")
    assert lexical.rank_documents(clash, asked).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.rank_documents(clash, asked).count() == 20
    assert simhash.simhash_components(clash).select("component_id").distinct().count() == 3
    assert spelling.spelling_variants(clash).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_very_long_texts(spark):
    began = time.time()
    docs = [(1, VERY_LONG), (2, VERY_LONG + "lorem"), (3, "x" * 3_000_000), (4, None)]
    df = frame(spark, docs)
    assert {r["component_id"] for r in simhash.simhash_components(df).filter("doc_id < 3").collect()} == {1}
    assert len(spelling.spelling_variants(df).collect()) == 0  # no word of seven letters occurs twice
    got = lexical.rank_documents(df, spark.createDataFrame([(1, "Ipsum")], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1, 2] or [r["doc_id"] for r in got] == [2, 1]
    assert time.time() - began < 120
