"""Rows that the tests of this folder share."""

import random

from pyspark.sql import types as T

#: documents with extra columns whose names operators use themselves.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("kept", "h", "_h", "uid", "row", "piece", "key", "sig", "label", "offset", "spans", "kind", "size")]
)
WORDS = "river stone quiet morning garden letter window silver autumn market bridge castle winter engine pocket summer harbor thunder meadow lantern".split()


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", "ed"]) for _ in range(n)) + "."


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), *["x"] * (len(SCHEMA) - 5))


def hard_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long_text = " ".join(prose(2000 + k, 400) for k in range(60))
    return [
        row(1, prose(1)),
        row(1, prose(1)),  # repeated row
        row(2, prose(1)),  # copy
        row(3, None, None),
        row(4, ""),
        row(5, " \n\t "),
        row(None, prose(5)),
        row(None, None, None),
        row(6, long_text),
        row(7, "word " * 3000),
        row(8, "one two three"),
        row(9, "Ωμέγα 漢字 naïve İstanbul ½ 👍🏽 é", None),
        row(10, "a" * 30_000),
        row(11, prose(11) + " token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\" " + prose(12)),
        row(12, "mail bob.smith@mail.example.com or +1 (415) 555-2671, host 10.1.2.255, card 4111 1111 1111 1111 now"),
        row(13, "tail <|endoftext|> head <|startoftext|>"),
    ]
