"""Queries of one code that are a large share of all queries get their result where they lie."""

import numpy as np
from pyspark.sql import functions as F

from placewise.llm import _shared, hamming


def test_many_queries_of_one_code(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 3)
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=64)
    vecs = [base.tolist()] * 30 + [rnd.normal(size=64).tolist() for _ in range(30)] + [(base * np.where(np.arange(64) == i, -1, 1)).tolist() for i in range(4)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    out = hamming.top_k(df, F.col("vec_id") % 2 == 0, k=5)
    assert out.columns == ["vec_id", "rank", "neighbor_id", "distance"] and dict(out.dtypes)["rank"] == "int"
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.distance, r.neighbor_id))
    bits = np.array(vecs) > 0
    assert set(got) == set(range(0, len(vecs), 2))
    for q, rows in got.items():
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(len(vecs)) if i != q)[:5]
        assert sorted(rows) == [(i, *w) for i, w in enumerate(want, 1)]
