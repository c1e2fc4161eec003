"""Presence as runs of snapshots, and copies compared by checksums of buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import history, reconcile

HEADS = "snapshot_id int, derived_at timestamp_ntz, violation_type string"
ROWS = "snapshot_id int, violation_type string, address string"


def world(spark, n, seed, flip=0.3, keys="abcdef"):
    rnd = random.Random(seed)
    heads = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), k) for i in range(1, n + 1) for k in ("x", "y")]
    on, rows = {}, []
    for i in range(1, n + 1):
        for k in ("x", "y"):
            for a in keys:
                if rnd.random() < flip:
                    on[k, a] = not on.get((k, a), False)
                if on.get((k, a)) or i == n and a == keys[0]:
                    rows.append((i, k, a))
    return spark.createDataFrame(heads, HEADS), rows


def as_runs(rows):
    at = {}
    for i, k, a in rows:
        at.setdefault((k, a), set()).add(i)
    return {(k, a, i, next(j for j in range(i, 10**6) if j + 1 not in s)) for (k, a), s in at.items() for i in s if i - 1 not in s}


def told(runs):
    got = [tuple(r) for r in runs.select("violation_type", "address", "first_ord", "last_ord").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_and_merges(spark, seed):
    heads, rows = world(spark, 9, seed)
    numbered = history.ordinals(heads)
    df = spark.createDataFrame(rows * 2, ROWS)
    assert told(history.runs_of(numbered, df)) == as_runs(rows)
    runs = history.runs_of(numbered, df.filter("snapshot_id = 1"))
    for i in range(2, 10):
        runs = spark.createDataFrame(history.next_runs(runs, df.filter(F.col("snapshot_id") == i), i).collect(), runs.schema)
        assert told(runs) == as_runs([r for r in rows if r[0] <= i])
    asked = spark.createDataFrame([(k, a) for k in "xyz" for a in "abcdefg"], "violation_type string, address string")
    there = set(rows)
    for r in history.presence_in(numbered, runs, asked).collect():
        assert r.present == ((r.snapshot_id, r.violation_type, r.address) in there) and r.ord == r.snapshot_id
    assert history.presence_in(numbered, runs, asked).count() == 2 * 7 * 9
    assert sorted(map(str, history.left_in(numbered, runs, asked).collect())) == sorted(map(str, history.left_when(heads, df, asked).collect()))
    assert history.next_runs(runs.limit(0), df.filter("snapshot_id = 3"), 3).filter("first_ord = 3 and last_ord = 3").count() == len({r[1:] for r in rows if r[0] == 3})


def test_a_thousand_snapshots_have_rows_in_proportion_to_changes(spark):
    heads, rows = world(spark, 1000, 3, flip=0.005, keys=[f"a{i}" for i in range(20)])
    runs = history.runs_of(history.ordinals(heads), spark.createDataFrame(rows, ROWS))
    assert told(runs) == as_runs(rows)
    assert runs.count() < len(rows) / 50


CALLS = "k long, j string, v double, w string, t timestamp"


def copies(spark, n=5000):
    rnd = random.Random(4)
    rows = [(None if i % 97 == 0 else i, rnd.choice(["p", None]) if i % 97 == 0 else "p", rnd.choice([None, 0.0, 1.5]), rnd.choice([None, "", "x"]), dt.datetime(2024, 1, 1, i % 24)) for i in range(n)]
    return rows, spark.createDataFrame(rows, CALLS)


def test_equal_copies_are_found_equal_without_a_join_of_rows(spark):
    _, a = copies(spark)
    b = a.repartition(7).orderBy(F.desc("w"))
    key, compare = ["k", "j"], ["v", "w", "t"]
    assert reconcile.unequal_buckets(a, b, key, compare).count() == 0
    row = reconcile.copies_agree(a, b, key, compare).first()
    assert (row.rows_a, row.rows_b, row.agree) == (5000, 5000, True)
    plan = reconcile.unequal_buckets(a, b, key, compare)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    none = a.limit(0)
    assert reconcile.copies_agree(none, none, key, compare).first().agree and not reconcile.copies_agree(a, none, key, compare).first().agree


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.withColumn("w", F.when(F.col("k") == 1234, "zz").otherwise(F.col("w"))),
        lambda d: d.withColumn("v", F.when((F.col("k") == 77) & F.col("v").isNull(), F.lit(0.0)).when(F.col("k") == 78, F.lit(None)).otherwise(F.col("v"))),
        lambda d: d.filter("k <> 9 or k is null"),
        lambda d: d.unionByName(d.filter("k = 5").withColumn("k", F.lit(-5).cast("long"))),
        lambda d: d.withColumn("v", F.when(F.col("k") == 11, 3.0).otherwise(F.col("v"))).withColumn("w", F.when(F.col("k") == 11, "n").otherwise(F.col("w"))),
    ],
)
def test_bucketed_diff_equals_the_whole_one(spark, change):
    rows, _ = copies(spark)
    a = spark.createDataFrame([r for r in rows if r[0] is not None], CALLS)
    b = change(a).repartition(5)
    key, compare = ["k", "j"], ["v", "w", "t"]
    whole, part = (sorted(map(str, f(a, b, key, compare).collect())) for f in (reconcile.row_diff, reconcile.bucketed_diff))
    assert part == whole
    assert reconcile.unequal_buckets(a, b, key, compare).count() == len({str(r).split("j=")[0] for r in whole}) <= 3
    assert reconcile.copies_agree(a, b, key, compare).first().agree == (not whole)


def test_nulls_are_told_from_values(spark):
    key, compare = ["k"], ["v", "w"]
    a = spark.createDataFrame([(1, "p", None), (2, None, "q")], "k long, v string, w string")
    b = spark.createDataFrame([(1, None, "p"), (2, "q", None)], "k long, v string, w string")
    assert not reconcile.copies_agree(a, b, key, compare).first().agree
    twice = a.unionByName(a)
    assert not reconcile.copies_agree(a, twice, key, compare).first().agree
