"""Deltas merged into keyed tables, the closest pairs among crowded addresses, figures from file footers."""

import datetime as dt
import io
import random
import shutil
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placewise.operators import freshness, geo, reconcile, select
from placewise.sources import layers
from placewise.streaming.landing import merge_published

SCHEMA = "request_id long, text string, written int"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def told(df):
    return sorted(map(tuple, df.select("request_id", "text", "written").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_equal_the_last_written(spark, tmp_path, seed):
    rnd = random.Random(seed)
    held = layers.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "request_id", "written", width=10)
    assert told(held.read()) == []
    said = {}
    for step in range(4):
        rows = {i: (i, rnd.choice(["a", "b", None]), step * 1000 + rnd.randrange(-1500, 999)) for i in rnd.sample(range(-30, 60), 25)}
        held.merge(spark.createDataFrame(list(rows.values()), SCHEMA).select("written", "request_id", "text"))
        for i, row in rows.items():
            if i not in said or row[2] > said[i][2]:
                said[i] = row
        assert told(held.read()) == sorted(said.values(), key=str)
    whole = spark.createDataFrame(list(said.values()), SCHEMA)
    assert told(select.upsert_by_key(whole.unionByName(held.read()), "request_id", "written")) == told(held.read())


def test_files_that_a_delta_does_not_meet_are_left_alone(spark, tmp_path):
    held = layers.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "request_id", "written", width=100)
    held.merge(spark.range(1000).select(F.col("id").alias("request_id"), F.lit("old").alias("text"), F.lit(1).alias("written")))
    before = files(f"{tmp_path}/t")
    assert len({n.split("/")[0] for n in before}) == 10
    held.merge(spark.createDataFrame([(250, "new", 2), (251, "stale", 0), (1000, "more", 1)], SCHEMA))
    after = files(f"{tmp_path}/t")
    kept = {n for n in before if "key_range=2/" not in n}
    assert all(after[n] == before[n] for n in kept) and {n.split("/")[0] for n in set(after) - kept} == {"key_range=2", "key_range=10"}
    assert told(held.read().filter("text <> 'old'")) == [(1000, "more", 1), (250, "new", 2)] and held.read().count() == 1001
    held.merge(spark.createDataFrame([], SCHEMA))
    assert files(f"{tmp_path}/t") == after
    plan = io.StringIO()
    with redirect_stdout(plan):
        held._ranges(held.path).filter(F.col(layers.RANGE).isin([2])).explain("formatted")
    assert "PartitionFilters: [isnotnull(key_range" in plan.getvalue() or "PartitionFilters: [(key_range" in plan.getvalue()
    with pytest.raises(Exception, match="request_id is null"):
        held.merge(spark.createDataFrame([(None, "x", 3)], SCHEMA))


def test_ranges_are_widened_until_files_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "MOST_RANGES", 8)
    make = lambda: layers.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "request_id", "written", width=10)
    rows = lambda text, at: spark.range(-500, 1500).select(F.col("id").alias("request_id"), F.lit(text).alias("text"), F.lit(at).alias("written"))
    make().merge(rows("old", 1))
    assert 2 <= len({n.split("/")[0] for n in files(f"{tmp_path}/t")}) <= 8
    make().merge(rows("new", 2).filter("request_id % 3 = 0"))
    make().merge(spark.createDataFrame([(1, "stale", 0), (9_999, "more", 1)], SCHEMA))
    want = [(i, "new", 2) if i % 3 == 0 else (i, "old", 1) for i in range(-500, 1500)] + [(9_999, "more", 1)]
    assert told(make().read()) == sorted(want, key=str)
    assert len({n.split("/")[0] for n in files(f"{tmp_path}/t")}) <= 9
    # Of many rows a range holds a bounded number.
    monkeypatch.setattr(layers, "RANGE_ROWS", 20)
    layers.KeyedTable(spark, f"{tmp_path}/u", SCHEMA, "request_id", "written", width=10).merge(rows("old", 1))
    assert len({n.split("/")[0] for n in files(f"{tmp_path}/u")}) > 20


@pytest.mark.parametrize("stop", ["before", "midway", "after"])
def test_a_merge_that_is_cut_short_is_finished_by_the_next(spark, tmp_path, monkeypatch, stop):
    make = lambda: layers.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "request_id", "written", width=10)
    make().merge(spark.createDataFrame([(i, "old", 1) for i in range(30)], SCHEMA))
    delta = spark.createDataFrame([(5, "new", 2), (35, "more", 2)], SCHEMA)
    real = layers.replace_partitions

    def cut(rows, path, *by):
        if stop == "after":
            real(rows, path, *by)
        if stop == "midway":  # the old partition is gone, the new one not yet there
            shutil.rmtree(f"{path}/key_range=0")
        raise RuntimeError("cut")

    held = make()
    monkeypatch.setattr(layers, "replace_partitions", cut)
    with pytest.raises(RuntimeError, match="cut"):
        held.merge(delta)
    monkeypatch.setattr(layers, "replace_partitions", real)
    want = sorted([(i, "new" if i == 5 else "old", 2 if i == 5 else 1) for i in range(30)] + [(35, "more", 2)], key=str)
    again = held if stop == "midway" else make()
    if again is held:
        again.merge(delta)
    assert told(again.read()) == want and not Path(f"{tmp_path}/t.pending").exists()
    again.merge(delta)
    assert told(again.read()) == want
    # What was only half written beside the table is not taken over.
    spark.createDataFrame([(1, "half", 9)], SCHEMA).withColumn(layers.RANGE, F.lit(0)).write.partitionBy(layers.RANGE).parquet(f"{tmp_path}/t.pending")
    Path(f"{tmp_path}/t.pending/_SUCCESS").unlink()
    assert told(make().read()) == want


def test_a_stream_of_deltas(spark, tmp_path, monkeypatch):
    held = layers.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "request_id", "written", width=10)
    run = lambda: merge_published(spark, f"{tmp_path}/in", held, f"{tmp_path}/cp")
    publish = lambda n, rows: spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/{n}")
    publish(1, [(1, "a", 1), (25, "b", 1)])
    run()
    publish(2, [(1, "same time", 1), (2, "c", 5)])
    publish(3, [(2, "older", 4), (25, None, 2)])
    real = layers.replace_partitions

    def cut(rows, path, *by):
        real(rows, path, *by)
        raise RuntimeError("cut")

    monkeypatch.setattr(layers, "replace_partitions", cut)
    with pytest.raises(Exception, match="cut"):
        run()
    monkeypatch.setattr(layers, "replace_partitions", real)
    run()  # the batch again
    want = sorted([(1, "same time", 1), (2, "c", 5), (25, None, 2)], key=str)
    assert told(held.read()) == want
    run()  # nothing new
    assert told(held.read()) == want


def test_samples_are_kept_once(spark, tmp_path):
    path, schema = f"{tmp_path}/s", "layer string, edited_at timestamp_ntz, business_key string, object_id long"
    one = lambda day, n: spark.createDataFrame([("census_areas", dt.datetime(2024, 1, day), str(i), i) for i in range(n)], schema)
    layers.keep_sample(one(1, 3), path)
    first = files(path)
    layers.keep_sample(one(2, 2), path)
    layers.keep_sample(one(2, 2), path)
    assert all(files(path)[n] == at for n, at in first.items())
    assert sorted(map(tuple, layers.read_samples(spark, path).collect())) == sorted(map(tuple, one(1, 3).union(one(2, 2)).collect()))


def points_of(spark, rows):
    """(door, metres east, metres north) as calls with addresses."""
    k = geo.C.METRES_PER_DEGREE
    east = F.col("x") / (k * F.cos(F.radians(F.lit(geo.C.REFERENCE_LATITUDE))))
    df = spark.createDataFrame(rows, "address string, x double, y double")
    return df.select(F.xxhash64("address").alias("request_id"), "address", (F.col("y") / k).alias("latitude"), east.alias("longitude"))


def brute(points, metres, limit):
    pts = sorted(map(tuple, points.collect()))
    near = [(geo.math.sqrt((x - u) ** 2 + (y - v) ** 2), a, b) for i, (a, x, y) in enumerate(pts) for b, u, v in pts[i + 1 :]]
    return sorted((round(d, 3), a, b) for d, a, b in near if d <= metres)[:limit]


@pytest.mark.parametrize("case", ["spread", "one point", "two points", "far apart", "few", "none"])
def test_closest_pairs(spark, case):
    rnd = random.Random(3)
    rows = {
        "spread": [(f"{i} A", rnd.uniform(1, 90), rnd.uniform(1, 90)) for i in range(150)] + [(f"{i} B", 50.0 + i / 64, 50.0) for i in range(20)],
        "one point": [(f"{i} A", 5.0, 5.0) for i in range(60)],
        "two points": [(f"{i} A", 5.0 + i % 2, 5.0) for i in range(3)] + [("9 B", 40.0, 1.0)],
        "far apart": [(f"{i} A", 100.0 * (i + 1), 5.0) for i in range(20)],
        "few": [("1 A", 5.0, 5.0), ("2 A", 30.0, 5.0), ("3 A", 5.0, 34.0)],
        "none": [],
    }[case]
    calls = points_of(spark, rows)
    got = [(r.metres, r.a, r.b) for r in geo.nearest_pairs(calls, 30.0, 8).collect()]
    assert got == brute(geo.address_points(calls), 30.0, 8) and len(got) == {"far apart": 0, "none": 0, "two points": 3, "few": 2}.get(case, 8)


def test_a_hundred_thousand_addresses_in_one_cell(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.concat(F.col("id").cast("string"), F.lit(" A")).alias("door"), (F.rand(5) * 30 + 60).alias("x"), (F.rand(6) * 30 + 60).alias("y")
    )
    radius = geo._closest_radius(rows, 30.0, 8).first()["radius"]
    met = geo._within(rows, F.lit(radius), F.lit(1e9)).count()  # all that a search compares
    assert met < 4 * n and geo._within(rows, F.lit(radius), F.lit(radius)).count() >= 8


def test_figures_come_from_footers(spark, tmp_path):
    rows = spark.range(100).select(
        F.col("id").alias("object_id"), F.concat(F.lit("layer"), (F.col("id") % 3).cast("string")).alias("layer"),
        F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("date_initiated"),
    )
    layers.write_counted(rows, f"{tmp_path}/all")
    layers.write_counted(rows, f"{tmp_path}/by", "layer")
    flat, by = layers.read_counted(spark, f"{tmp_path}/all"), layers.read_counted(spark, f"{tmp_path}/by")

    def pushed(df):
        plan = io.StringIO()
        with redirect_stdout(plan):
            df.explain("formatted")
        return [line for line in plan.getvalue().splitlines() if line.startswith("PushedAggregation")]

    same = reconcile.version_identity(flat)
    assert pushed(same) == ["PushedAggregation: [COUNT(*), MAX(object_id)]"] and same.first() == reconcile.version_identity(rows).first()
    newest = freshness.newest_call(flat, "date_initiated_us")
    assert pushed(newest) == ["PushedAggregation: [MAX(date_initiated_us)]"] and newest.collect() == freshness.newest_call(rows).collect()
    counts = reconcile.stored_counts(by)
    assert pushed(counts) == ["PushedAggregation: [COUNT(*)]"] and sorted(map(tuple, counts.collect())) == [("layer0", 34), ("layer1", 33), ("layer2", 33)]
    assert "PushedAggregation" not in str(pushed(reconcile.version_identity(spark.read.parquet(f"{tmp_path}/all"))))
