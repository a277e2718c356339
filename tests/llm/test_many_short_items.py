"""Benchmark blocks of many short items, where one key holds text, item and band."""

import numpy as np

from tidebook.llm import decontaminate


def test_texts_times_items_beyond_a_key():
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    items = ["".join(x) for x in letters[rng.integers(0, 26, (150_000, 12))]]
    texts = [""] * 9_000
    want = [(0, 7), (3_000, 149_000), (8_000, 100_000), (8_999, 149_999)]
    for t, i in want:
        texts[t] = f"0123456789 {items[i]} 9876543210"
    made = decontaminate.Items(list(enumerate(items)))
    assert len(texts) * len(items) > 1 << 30
    assert [(t, i, d, s, e) for t, i, d, s, e in made.search(texts)] == [(t, i, 0, 11, 23) for t, i in want]
