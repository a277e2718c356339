"""The pipeline against a brute-force version of each stage's decisions."""

import corpus_pipeline
from test_operators import brute_links, check_packing, edits

from tidebook.llm import decontaminate, quality, secrets


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    f = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]

    good = f["quality rules"](spark, docs, small)
    kept = {r["doc_id"] for r in quality.quality_rules(docs).filter("kept").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == kept

    one = f["n-gram Jaccard join"](spark, good, small)
    left = {c for _, c, _ in brute_links([(i, rows[i]) for i in sorted(kept)])}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(left)

    clean = f["benchmark decontamination"](spark, one, small)
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {i for i in left for t in items if t in rows[i]}
    stays = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and not stays & held
    for i in left - held - stays:  # what else went holds an item with few edits
        assert any(edits(decontaminate.normal(t), decontaminate.normal(rows[i])) <= 0.08 * len(t) for t in items)

    masked = f["secret scans"](spark, clean, small)
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert masked.columns == columns and set(text) == stays
    for i in stays:
        assert not secrets.values(text[i], [s for s in secrets.base_spans(text[i]) if "[SECRET]" not in text[i][s[0] : s[2] + 9]])
        if not secrets.base_spans(rows[i]):
            assert text[i] == rows[i] or "[SECRET]" in text[i]
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())

    n, total = check_packing(sorted(text.items()), f["best-fit packing"](spark, masked, small))
    assert n <= total // 2048 + 2


def test_run_gives_packed_rows(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns)
    assert out.count() > 100
