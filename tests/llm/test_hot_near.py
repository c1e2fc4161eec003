"""Hot bands and hubs, rows that share an id but not a text, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from placewise.llm import _shared, near_dedup

from test_corpus_operators import _components


def _texts():
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(150):  # one large group, edits of one text
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(60)] = f"e{rnd.randint(0, 99)}"
        out.append(" ".join(t))
    return out + [out[0]] * 40 + [" ".join(f"z{rnd.randint(0, 50)}" for _ in range(30)) for _ in range(40)]


@pytest.mark.parametrize("hot", [4, 512])
def test_hot_groups_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(_shared, "HOT_ROWS", hot)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = _texts()
    want, _ = _components(texts, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dedup.near_duplicates(df, threshold_pct=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_blocks_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    texts = _texts()
    want, _ = _components(texts, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, threshold_pct=85).collect()} == want


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a + " more"), (5, b), (7, b + " more"), (None, b), (5, None)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, id string, sha string, _dropped string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (None, None, True), (5, 5, True)], key=str)
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, a), (5, b), (0, b), (5, "")])


def test_keyed_join_equals_plain_join(spark, monkeypatch):
    left = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("rows")).withColumn("v", F.col("k") * 2).filter("k <> 7")
    plain = {(r.id, r.v) for r in left.join(right, "k").collect()}
    outer = {(r.id, r.v) for r in left.join(right, "k", "left").collect()}
    for hot in (1, 100, 10_000):
        monkeypatch.setattr(_shared, "HOT_ROWS", hot)
        assert {(r.id, r.v) for r in _shared.join_keyed(left, right, "k").collect()} == plain
        assert {(r.id, r.v) for r in _shared.join_keyed(left, right, "k", how="left").collect()} == outer
