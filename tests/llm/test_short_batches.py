"""Texts go to Python in short batches, so that few lie beside the heap."""

import numpy as np
import pytest

from placewise.llm import near_dedup, packing, toxicity
from placewise.llm._shared import short_batches
from placewise.llm.queries import tokenizer_file

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def default_batches(spark):
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield
    spark.conf.set(KEY, before)


def pieces(docs):
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


def scores(docs):
    return toxicity.score(docs, toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), 0.0))


@pytest.mark.parametrize("module, of", [(packing, pieces), (near_dedup, near_dedup.near_duplicates), (toxicity, scores)])
def test_whole_texts_come_in_short_batches(spark, default_batches, monkeypatch, module, of):
    def short(batches):
        for batch in batches:
            if batch.num_rows > 512:
                raise ValueError(f"{batch.num_rows} texts at once")
            yield batch

    monkeypatch.setattr(module, "slices", short)
    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert of(docs).count() == 2000
    assert {r[0] for r in of(docs).select("doc_id").collect()} == set(range(2000))


def test_a_smaller_number_stays(spark, default_batches):
    for given, then in (("100", "100"), ("0", "512"), ("-1", "512"), ("10000", "512")):
        spark.conf.set(KEY, given)
        short_batches(spark)
        assert spark.conf.get(KEY) == then
