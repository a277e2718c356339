"""A large cluster of near copies: rows between the steps grow with its members, and all links are counted."""

import random

from pyspark.sql import functions as F
from rows import SCHEMA, prose, row
from test_operators import brute_links, near_rows, same

from tidebook.llm import jaccard


def test_rows_between_grow_with_members(spark, monkeypatch):
    rng, base, n = random.Random(8), prose(77, 150).split(), 3000
    docs = []
    for k in range(n):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{k}"
        docs.append((k, " ".join(w)))
    rows, wrote = {}, jaccard.staged

    def seen(df, name):
        out = wrote(df, name)
        rows[name] = (out.count(), [f.dataType.typeName() for f in out.schema])
        return out

    monkeypatch.setattr(jaccard, "staged", seen)
    df = spark.createDataFrame([row(*d) for d in docs], SCHEMA).repartition(8)
    out = jaccard.jaccard_join(df).agg(F.countDistinct("class_id"), F.min("n_links"), F.max("n_links"), F.count("*")).first()
    assert tuple(out) == (1, n - 1, n - 1, n)
    blocks = -(-n // jaccard.TILE)
    for name, (count, kinds) in rows.items():
        assert "array" not in kinds and count <= n * blocks * jaccard.BANDS, name
    assert rows["links"][0] <= n * blocks * 12


def test_tiles_bounded_in_bytes(spark):
    rows = near_rows(9, 6)
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    same(brute_links(rows), jaccard.jaccard_join(df, tile_bytes=3000), "class_id", "n_links")
