"""Parts that are encoded together have the ids that each has alone."""

import random

import numpy as np
from public_tokenizers import path

from tidebook.llm import packing


def test_parts_encoded_together():
    encoder = packing.Encoder(path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = "abcz0189'!?<|>-\u00e9\u00df\u00b2\u00bd\u00aa\u00ad\u0001\u001c\u007f\u0085\u00a0 "
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(400)] + ["it's 'sorry' \u4e2d\u6587 e\u0301t\u00e9 \ufb01n", "x" * 5000]
    parts = list(dict.fromkeys(p for t in texts for p in packing.parts_of(t)))
    flat, sizes = encoder._encoded(parts)
    alone = [x.ids for x in encoder.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, alone)) and flat.tolist() == [i for ids in alone for i in ids]
    for text, ids in zip(texts, encoder.batch(texts)):
        assert np.array_equal(ids[:-1], encoder.tokenizer.encode(text, add_special_tokens=False).ids)
