"""Every candidate of the bands is verified on its full set, however few coordinates of its sketch agree."""

import random

import numpy as np
import pyarrow as pa

from placewise.llm import near_dedup

FEW = dict(coords=8, rows=1)  # so few coordinates that their agreement says little: bands miss a pair at 0.8 with 0.2^8


def test_links_do_not_hang_on_the_sketches_agreement(spark):
    rnd, texts = random.Random(11), []
    for i in range(200):
        t = [f"w{i}x{k}" for k in range(100)]
        u = list(t)
        for k in (20, 70)[: 1 + i % 2]:
            u[k] = f"e{rnd.randint(0, 9999)}"  # each edit replaces five of 96 shingles: 0.9 and 0.81
        texts += [" ".join(t), " ".join(u)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, threshold_pct=80, **FEW).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_open_buckets_do_not_hang_on_it_either():
    a, b = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    longer = np.arange(200, dtype=np.uint64)
    sk = [np.zeros(8, np.uint32), np.r_[np.uint32(0), np.arange(1, 8, dtype=np.uint32)], np.r_[np.uint32(0), np.arange(11, 18, dtype=np.uint32)]]
    rows = [dict(band=1, at=0, side=s, id=i, comp=i, sk=sk[i].tobytes(), hashes=h.tobytes()) for s in (0, 1) for i, h in enumerate((a, b, longer))]
    got = near_dedup._forest(80, 8, 1)(pa.Table.from_pylist(rows)).to_pylist()
    assert got == [{"a": 0, "b": 1}]
