"""The whole pipeline on hard rows and on an empty table."""

import corpus_pipeline
import pytest
from rows import SCHEMA, hard_rows, prose, row

from tidebook.llm import quality


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = [(1, prose(900, 40)), (2, None), (3, ""), (1, prose(900, 40))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_hard_rows(spark, tmp_path):
    import zstandard

    rows = hard_rows() + [
        row(20, prose(700, 50) + " " + prose(900, 40) + " " + prose(701, 50)),  # holds an item
        row(21, prose(702, 200)),
        row(22, prose(702, 200) + " tail"),  # near copy
        row(23, prose(703, 90) + " password=Summer2024Kq9 " + prose(704, 90)),
    ]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, rows)).collect()
    squeeze = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    good = {r[0] for r in rows if r[0] is not None and quality.measure(r[1] or "", squeeze)[6]}
    copies = {2, 22}  # of 1 and 21, which stay
    assert {1, 20, 21, 23} <= good
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == good - copies - {20}
    held = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 2048
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out)  # the repeated row stays once


@pytest.mark.parametrize("rows", [[], [row(1, None), row(2, ""), row(None, " \n")]])
def test_run_on_nothing(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, rows)).count() == 0
