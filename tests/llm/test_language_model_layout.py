"""Shards and frequent words of a language model come from all training texts, in whatever order they lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import kneser_ney
from tidebook.llm.kneser_ney import END, fit, hash_words


@pytest.mark.parametrize("per_shard", [10_000, 100_000])
def test_short_texts_first(spark, per_shard):
    short, many, length = 3_000, 300, 1_000
    long_text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(length // 2)), lambda i: F.concat(F.lit("late w"), F.col("id") * 1000 + i)))
    docs = spark.range(0, short + many, 1, 4).select(F.when(F.col("id") < short, F.concat(F.lit("note "), F.col("id"))).otherwise(long_text).alias("text"))
    model = fit(docs, per_shard=per_shard)
    total = short * 3 + many * (length + 1)
    assert model.tokens == total and model.shards == max(4, total // per_shard)
    want = [h for h, n in ((hash_words([b"late"])[0], many * length // 2), (hash_words([b"note"])[0], short)) if n * 8 * model.shards > total]
    assert model.hot.tolist() == np.unique(np.array([*want, END], np.uint64)).tolist()
    assert hash_words([b"late"])[0] in model.hot


def test_no_texts(spark, none):
    shards, hot = kneser_ney.layout(none.select("text"), 1000)
    assert shards == 4 and hot.tolist() == [END]


def test_words_of_many_partitions_are_summed():
    import pyarrow as pa

    n = np.arange(1000)
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part), pa.array(part)], names=["word", "n"])
    (out,) = kneser_ney._frequent(900.0)([batch(n[:500]), batch(n[500:])])
    assert sorted(out.column("word").to_pylist()[:-1]) == list(range(901, 1000)) and sum(out.column("n").to_pylist()) == n.sum()
