"""Secret values that go on where the base patterns stop."""

import pytest
from tidebook.llm import secrets

from rows import SCHEMA, row

VALUES = ["Summer2024#x9Kq", "Winter2023!x9Kq", "hunter482%Tr5zq", "abcd123&k8Wq"]


@pytest.mark.parametrize("value", VALUES)
def test_a_span_that_reaches_beyond_a_base_span_stays(value):
    text = f"first line\npassword={value} and more"
    at = text.index(value)
    base, every = secrets.scan(text, [(at, at + len(value))])
    assert base == secrets.base_spans(text) and len(base) == 1 and base[0][2] < at + len(value)
    assert every == [*base, (at, 3, at + len(value))]


def test_spans_that_base_spans_cover_go():
    text = "password=" + "0123456789abcdef" * 3
    base, every = secrets.scan(text, [(9, len(text)), (20, 30)])
    assert [k for _, k, _ in base] == [0, 2] and every == base
    assert secrets.merged([(0, 0, 3), (3, 1, 6), (8, 0, 9), (8, 1, 12)]) == ([0, 8], [6, 12])


def test_tails_are_told_and_redacted(spark):
    words = "the boat went over the bay to the old pier where nets dried in a light wind".split()
    prose = lambda k: " ".join(words[(k * 7 + j * (1 + k % 5)) % len(words)] for j in range(60))
    docs = [row(i, prose(i)) for i in range(400)]
    docs += [row(1000 + i, f"{prose(i)} password={v} {prose(i + 1)}") for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(docs, SCHEMA)
    told = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    for i, v in enumerate(VALUES):
        assert "crf" in told[1000 + i], (v, told[1000 + i])
        assert f"password=[SECRET] {prose(i + 1)}" in out[1000 + i], (v, out[1000 + i])
