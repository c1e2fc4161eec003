"""Counts, ratios and scores of the toxicity model against brute force; hashed n-grams one byte at a time."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import toxicity

M = 0xFFFFFFFF


def _buckets(text):
    data = b" " + (text or "").lower().encode() + b" "
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(data) - n + 1):
            h = data[i] + 1
            for c in data[i + 1 : i + n]:
                h = (h * 0x01000193 & M) ^ (c + 1)
            x = h * 0x9E3779B1 & M
            x ^= x >> 15
            out.add((x * 0x85EBCA77 + n & M) >> (32 - toxicity.BITS))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "vile", "rotten"]
    out = [(i, " ".join(rnd.choice(words[: 5 + 2 * (i % 3 == 0)]) for _ in range(rnd.randint(0, 12))), int(i % 3 == 0)) for i in range(80)]
    return out + [(80, None, 0), (81, "", 1), (82, "left out", None), (3, out[3][1], 1)]


def test_model_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, key=F.col("doc_id"), max_features=1 << toxicity.BITS, steps=40)
    sets = [(_buckets(t), y) for _, t, y in rows if y is not None]
    p, q = Counter(), Counter()
    for s, y in sets:
        (p if y else q).update(s)
    kept = [f for f in p.keys() | q.keys() if p[f] + q[f] >= toxicity.MIN_DOCS]
    tp, tq = sum(p[f] + 1 for f in kept), sum(q[f] + 1 for f in kept)
    ratio = {f: math.log((p[f] + 1) / tp) - math.log((q[f] + 1) / tq) for f in kept}
    assert set(np.flatnonzero(model.weights)) <= set(kept)

    def loss(weights, bias):
        """Mean logistic loss of the rows by bucket weights."""
        z = np.array([sum(weights[f] for f in s) + bias for s, _ in sets])
        y = np.array([y for _, y in sets])
        return np.log1p(np.exp(-np.where(y == 1, z, -z))).mean()

    # The weights are those of a logistic fit on x * r: moving along any feature's own ratio gains next to nothing.
    full = toxicity.fit(df, key=F.col("doc_id"), max_features=1 << toxicity.BITS, steps=2000, l2=0.0)
    base = loss(full.weights, full.bias)
    for f in random.Random(1).sample(sorted(kept), 25):
        moved = full.weights.copy()
        moved[f] += 1e-4 * ratio[f]
        assert abs(loss(moved, full.bias) - base) < 1e-5
    assert base < loss(np.zeros_like(full.weights), full.bias) / 2

    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, t, _ in rows:
        z = sum(float(np.float32(model.weights[f])) for f in _buckets(t)) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_sample_is_bounded_exactly(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "_logistic", lambda cols, y, ratio, size, l2, steps: seen.update(n=len(y), size=size) or (np.zeros_like(ratio), 0.0))
    df = spark.createDataFrame([("the same text", 0)] * 500 + [(f"other {i} words", 1) for i in range(300)], "text string, toxic int")
    toxicity.fit(df, max_per_class=50)
    assert seen == {"n": 51, "size": {0: 500, 1: 300}}


def test_clashing_names_long_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, 0.5, "x"), (2, "", 0.5, "y"), (2, None, None, None)], "doc_id long, text string, SCORE double, h string")
    out = toxicity.score(df, toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), 1.0))
    assert out.columns == ["doc_id", "text", "h", "score"]
    assert {round(r.score, 6) for r in out.collect()} == {round(1 / (1 + math.exp(-1)), 6)}
