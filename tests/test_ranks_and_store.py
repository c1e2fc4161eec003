"""Ranks of lists of any scores, and landed tables that join and aggregate without a shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.operators import places, select
from placewise.plans.adapter import Inputs
from placewise.plans.queries import everything, typed
from placewise.sources import layers

TABLES = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_ranges(spark):
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_million_scores_are_ranked_in_ranges(spark, many_ranges):
    n = 1_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("then"), (F.xxhash64("id") / 3).alias("score"))
    out = places.numbered(rows, [], [F.negative("score"), F.col("then")])
    windows = re.findall(r"Window \[[^\n]*", plan_of(out))
    assert windows and all("_n" in w for w in windows)  # sums of counts alone, never a numbering of rows
    wrong = rows.join(out.select("then", "rank"), "then").select("score", "rank", F.lag("rank").over(Window.orderBy(F.desc("score"), "then")).alias("before"))
    assert wrong.filter("rank <> coalesce(before, 0) + 1").count() == 0 and out.count() == n
    sizes = [r["n"] for r in spark.read.parquet(*[p for p in out.inputFiles() if "/ordered-" in p]).groupBy(F.spark_partition_id(), F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 4 * n / len(sizes)


@pytest.mark.parametrize("short", [0, 10_000])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_ranks_equal_a_sort(spark, many_ranges, by, short):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 2, 2]), rnd.choice([0.5, 1.5, None, 2.0]), i) for i in range(700)]
    rows = spark.createDataFrame(data, "g string, h int, score double, then int")
    got = {r.then: r["rank"] for r in places.numbered(rows, by, [F.negative("score"), F.col("then")], short).collect()}
    groups = {}
    for g, h, score, then in data:
        groups.setdefault(tuple({"g": g, "h": h}[c] for c in by), []).append(((score is not None, -(score or 0)), then))
    want = {then: k for rows_ in groups.values() for k, (_, then) in enumerate(sorted(rows_), 1)}
    assert got == want
    assert places.numbered(rows.limit(0), by, [F.col("then")], short).count() == 0


def test_blocks_are_ranked_without_a_sort_of_all(spark, monkeypatch):
    monkeypatch.setattr(places.numbered, "__defaults__", (0,))
    doors = spark.createDataFrame([(f"a{i}", f"b{i // 2 % 40}", "s", "1", 3, 4, 1, 10, i) for i in range(160)], "address string, block string, street string, district string, calls_12mo int, calls_total int, tows int, block_dwellings int, rank int")
    out = places.blocks(doors)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 41))
    assert "row_number" not in plan_of(out)


def test_pivot_and_joins_read_the_store_without_a_shuffle(spark):
    t = Inputs(spark, TABLES)
    for df in (select.pivot_attributes(t.fields), everything(t), typed(t), select.load(t.calls, t.fields, select.ids_by_type(t.fields, t.dim, "Urgent or high").select("request_id"))):
        plan = plan_of(df)
        assert not re.search(r"Exchange hashpartitioning\(request_id|Sort \[request_id", plan) and "Bucketed: true" in plan
    plain = Inputs(spark, TABLES)
    a, b = t.fields.exceptAll(plain._view("fields")), plain._view("fields").exceptAll(t.fields)
    assert a.count() == b.count() == 0 and t.calls.count() == plain._view("calls").count()


def test_a_folder_is_landed_once_until_it_changes(spark, tmp_path):
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = Inputs(spark, str(tmp_path)).calls
    assert Inputs(spark, str(tmp_path)).calls.inputFiles() == first.inputFiles()
    n = first.count()
    spark.read.parquet(f"{TABLES}/orders.parquet").limit(10).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert Inputs(spark, str(tmp_path)).calls.count() == n + 10


def test_buckets_grow_with_the_data():
    assert [layers.buckets_for(b) for b in (0, 1 << 30, (1 << 30) + 1, 1 << 40)] == [8, 8, 16, 8192]
