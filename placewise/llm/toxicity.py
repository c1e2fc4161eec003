"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of the lower-cased text, present or absent. Their log-count ratios
``r = log((p + a) / |p + a|) - log((q + a) / |q + a|)`` come from the document counts of all training rows,
summed with map-side combine into at most 2 ** BITS rows. A logistic regression on ``x * r`` is then fitted
to a bounded sample of training rows (``max_per_class`` of each class, those of the smallest hashes), with
the features of the largest ratios (``max_features``). Scoring reads each whole text once, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import short_batches, slices

ORDERS = (3, 4, 5)
BITS = 18
MAX_PER_CLASS = 2500
MAX_FEATURES = 4_000
MIN_DOCS = 4
CHUNK = 1 << 20


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _chunks(texts: list[bytes]):
    """``(first row, lengths, bytes)`` of runs of whole texts, a space before and after each."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 2
            end += 1
        joined = b"".join(b" " + t + b" " for t in texts[start:end])
        yield start, [len(t) + 2 for t in texts[start:end]], np.frombuffer(joined, np.uint8)
        start = end


def _buckets(data: np.ndarray, orders=ORDERS, bits: int = BITS):
    """``(n, the bucket of the n-gram at each position)`` for each order."""
    data = data.astype(np.uint32) + np.uint32(1)
    h = data
    for n in range(2, max(orders) + 1):
        m = max(len(data) - n + 1, 0)
        h = h[:m] * np.uint32(0x01000193) ^ data[n - 1 : n - 1 + m]
        if n in orders:
            x = h * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            yield n, (x * np.uint32(0x85EBCA77) + np.uint32(n)) >> np.uint32(32 - bits)


def feature_rows(texts: list[bytes], wanted: np.ndarray):
    """``(row, feature)`` arrays, sorted: each row's distinct n-gram buckets of those marked in ``wanted``."""
    keys = [np.empty(0, np.int64)]
    for start, lengths, data in _chunks(texts):
        owner = np.repeat(np.arange(start, start + len(lengths), dtype=np.int64), lengths)
        for n, f in _buckets(data):
            at = np.flatnonzero(wanted[f])
            at = at[owner[at] == owner[at + n - 1]]
            keys.append(owner[at] << BITS | f[at])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _counts(batches):
    """Document counts of features by class, one row per feature seen in the partition."""
    total = np.zeros((2, 1 << BITS), np.int64)
    seen = np.zeros(1 << BITS, bool)
    for batch in slices(batches):
        labels = batch.column(1).to_pylist()
        for start, lengths, data in _chunks(_texts(batch.column(0))):
            found = list(_buckets(data))
            left = 0
            for i, size in enumerate(lengths):
                for n, f in found:
                    seen[f[left : max(left, left + size - n + 1)]] = True
                at = np.flatnonzero(seen)
                seen[at] = False
                total[labels[start + i], at] += 1
                left += size
    at = np.flatnonzero(total.any(axis=0))
    for part in np.array_split(at, max(1, len(at) // 50_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], names=["f", "q", "p"]
        )


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one per bucket; zero for features left out
    bias: float
    rows: int = 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        row, feat = feature_rows(texts, self.weights != 0)
        z = np.bincount(row, weights=self.weights[feat], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "toxic",
    key: Column | None = None,
    max_per_class: int = MAX_PER_CLASS,
    max_features: int = MAX_FEATURES,
    alpha: float = 1.0,
    l2: float = 1e-4,
    steps: int = 150,
) -> ToxicityModel:
    """Fit to rows of text and a 0/1 label; rows with another or no label are left out.

    With one class or none, the model scores every text at the share of label 1 (0 without rows). ``key``
    orders the rows of a class for the bounded sample: by its hash, one row of each (of rows that repeat a key, the
    smallest text). Repeated rows count each in the ratios. Null texts are empty.
    """
    spark = labelled.sparkSession
    short_batches(spark)
    rows = labelled.select(
        F.coalesce(labelled[text_col], F.lit("")).alias("text"),
        labelled[label_col].cast("int").alias("label"),
        F.xxhash64(key if key is not None else labelled[text_col], F.lit(1)).alias("h"),
    ).filter("label in (0, 1)")
    counts = (
        rows.select("text", "label").mapInArrow(_counts, "f long, q long, p long")
        .groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).filter(F.col("p") + F.col("q") >= MIN_DOCS)
        .toPandas()
    )  # at most 2 ** BITS rows
    size = dict(rows.groupBy("label").count().collect())
    n = sum(size.values())
    if len(size) < 2 or counts.empty:
        share = size.get(1, 0) / n if n else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(1 << BITS), math.log(share / (1 - share)), n)
    f, q, p = (counts[c].to_numpy() for c in ("f", "q", "p"))
    r = np.log((p + alpha) / (p + alpha).sum()) - np.log((q + alpha) / (q + alpha).sum())
    spread = np.abs(r) * np.sqrt(np.minimum(p / size[1], 1) + q / size[0])  # large ratios that occur
    best = np.lexsort((f, -spread))[:max_features]
    ratio = np.zeros(1 << BITS)
    ratio[f[best]] = r[best]

    # The max_per_class smallest hashes of each class, one row of each: an exact bound, also where rows repeat.
    hashes = rows.select("label", "h").distinct()
    cut = {k: hashes.filter(F.col("label") == k).orderBy("h").limit(max_per_class).agg(F.max("h")).first()[0] for k in (0, 1)}
    chosen = ((F.col("label") == 0) & (F.col("h") <= cut[0])) | ((F.col("label") == 1) & (F.col("h") <= cut[1]))

    wanted = spark.sparkContext.broadcast(np.packbits(ratio != 0))

    def features(batches):
        marked = np.unpackbits(wanted.value).astype(bool)
        for batch in slices(batches):
            texts = _texts(batch.column(0))
            row, feat = feature_rows(texts, marked)
            at = np.searchsorted(row, np.arange(len(texts) + 1))
            sets = [feat[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sets, pa.binary())], names=["y", "h", "x"])

    sample = rows.filter(chosen).groupBy("label", "h").agg(F.min("text").alias("text")).select("text", "label", "h")
    sample = sample.mapInArrow(features, "y int, h long, x binary")
    sample = sorted((h, y, bytes(x)) for y, h, x in sample.toLocalIterator())
    wanted.unpersist()
    y = np.array([s[1] for s in sample], np.float64)
    cols = [np.frombuffer(s[2], np.int32) for s in sample]
    sample.clear()
    weights, bias = _logistic(cols, y, ratio, size, l2, steps)
    return ToxicityModel(weights * ratio, bias, n)


def _logistic(cols: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, size: dict, l2: float, steps: int):
    """Weights on x * r by accelerated full-batch gradient steps; classes weigh as in all training rows."""
    if not len(y) or y.min() == y.max():
        share = size.get(1, 0) / max(1, sum(size.values()))
        return np.zeros_like(ratio), math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols)
    used, col = np.unique(col, return_inverse=True)
    x = ratio[used][col]
    norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(y))).mean() or 1.0
    x = (x / norm).astype(np.float64)
    weight = np.where(y == 1, size[1] / (y == 1).sum(), size[0] / (y == 0).sum())
    weight /= weight.sum()
    w, b = np.zeros(len(used)), math.log(size[1] / size[0])
    # A step bounded by the largest curvature, with Nesterov's momentum.
    v = np.ones(len(used))
    for _ in range(12):
        v = np.bincount(col, weights=x * (weight * np.bincount(row, weights=x * v[col], minlength=len(y)))[row], minlength=len(used))
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1.0 / (0.25 * (top + 1.0) + l2)
    w0, b0, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(row, weights=x * w[col], minlength=len(y)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.bincount(col, weights=x * e[row], minlength=len(used)) + l2 * w
        w1, b1 = w - rate * g, b - rate * e.sum()
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, b = w1 + (t - 1) / t1 * (w1 - w0), b1 + (t - 1) / t1 * (b1 - b0)
        w0, b0, t = w1, b1, t1
    out = np.zeros_like(ratio)
    out[used] = w0 / norm
    return out, float(b0)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """The input's columns and ``as_col``, a double from 0 to 1.

    A null text counts as empty; an empty text gets the model's bias. An input column named ``as_col``, in any case,
    is replaced. Repeated rows get the same score each. An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    keep = [c for c in docs.columns if c.lower() != as_col.lower()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(as_col, T.DoubleType())])
    at = keep.index(text_col)

    def run(batches):
        m = ToxicityModel(*shared.value)
        for batch in slices(batches):
            s = m.score(_texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*keep, as_col])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(run, schema)
