"""What keeps tasks, files and passes bounded as tables grow."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placewise.operators import geo, places, ranking, reconcile, versions
from placewise.plans.adapter import Inputs
from placewise.sources import layers

from test_places import calls_of, donut, fields_of  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_are_of_rows_in_memory_not_of_compressed_tables(spark, tmp_path, monkeypatch):
    shutil.copytree(SF, tmp_path / "sf")
    monkeypatch.setattr(layers, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(layers, "BUCKET_BYTES", layers.size_and_time(spark, [f"{tmp_path}/sf/{t}.parquet" for t in ("orders", "lineitem")])[0] * 2)
    fields = Inputs(spark, f"{tmp_path}/sf").fields
    assert len({r[0] for r in fields.select(F.input_file_name()).distinct().collect()}) > 1


def test_runs_are_written_without_columns_that_no_list_says(spark, monkeypatch):
    from placewise.operators import select

    calls = calls_of(spark, [(i, i, "1 oak st", {}) for i in range(1, 9)])
    loaded = select.load(calls, fields_of(spark, [(i, {}) for i in range(1, 9)])).withColumn("description", F.lit("long text"))
    busy, written = spark.createDataFrame([("1 OAK ST",)], "door string"), []
    for module in (places, ranking):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda df, name, real=real: written.append(set(df.columns)) or real(df, name))
    got = places.door_measures(loaded, busy=busy)
    assert got.first().calls_total == 8 and len(written) >= 3
    assert not any({"description", "object_id", "address", "date_closed"} & w for w in written)


def test_listed_doorways_are_worked_out_once_before_they_are_placed(spark, donut, monkeypatch):  # noqa: F811
    from placewise.operators import select

    calls = calls_of(spark, [(i, 0, f"{i} oak st", {"lat": 1.0, "lon": 1.0}) for i in range(1, 5)])
    loaded, real, seen = select.load(calls, fields_of(spark, [(i, {}) for i in range(1, 5)])), places.locate, []
    monkeypatch.setattr(places, "locate", lambda rows, *a, **k: seen.append(plan_of(rows)) or real(rows, *a, **k))
    assert places.doorways(loaded, geo.cover(*donut, carry=["dwellings"]), min_calls=1).count() == 4
    assert len(seen) == 1 and "Window" not in seen[0]


def test_nothing_is_derived_for_a_version_that_is_kept(spark, monkeypatch):
    real, runs = places.doorways, []
    monkeypatch.setattr(places, "doorways", lambda *a, **k: runs.append(1) or real(*a, **k))
    rows = __spark_entry__.queries()["retained_snapshots"](spark, SF).collect()
    assert len(runs) == 2 and {r.snapshot_id for r in rows} == {1, 2}


def test_a_landed_version_is_joined_once(spark, monkeypatch):
    real, seen = versions.snapshot_version, []
    monkeypatch.setattr(versions, "snapshot_version", lambda loaded, *a: seen.append(plan_of(loaded)) or real(loaded, *a))
    __spark_entry__.queries()["derived_versions"](spark, SF)
    assert seen and not any("Join" in p for p in seen)


def test_each_copy_is_read_once(spark, monkeypatch):
    real, reads = reconcile.bucket_digests, []
    monkeypatch.setattr(reconcile, "bucket_digests", lambda *a, **k: reads.append(1) or real(*a, **k))
    a = spark.range(100).select(F.col("id").alias("request_id"), F.lit("x").alias("status"))
    b = a.withColumn("status", F.when(F.col("request_id") == 5, "y").otherwise("x"))
    assert reconcile.copies_agree(a, a, ["request_id"], ["status"]).first()[:] == (100, 100, True)
    assert reconcile.copies_agree(a, b, ["request_id"], ["status"]).first()[:] == (100, 100, False)
    assert len(reads) == 4


def test_spreads_read_the_calls_once(spark):
    calls = spark.createDataFrame([(1, "1 a", 44.0, -63.0), (2, "1 a", 44.0, -63.0), (3, "1 a", 44.001, -63.0)], "request_id long, address string, latitude double, longitude double")
    got = geo.spreads(calls)
    assert "latitude" not in plan_of(got)
    row = got.first()
    assert row.calls == 3 and row.spread == pytest.approx(111.32, abs=0.01)


def test_pages_are_compressed(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("REQUESTID"), F.lit(1).cast("long").alias("CUSTOM_FIELD_ID"), F.lit("n").alias("CUSTOM_FIELD_NAME"), F.lit(None).cast("string").alias("CUSTOM_FIELD_VALUE"), F.col("id").alias("ObjectId"))
    layers.write_feature_pages(rows, layers.CUSTOM_FIELDS, f"{tmp_path}/p", "ObjectId")
    assert {p.suffix for p in Path(f"{tmp_path}/p").glob("part-*")} == {".gz"}
    back = layers.read_feature_pages(spark, f"{tmp_path}/p", layers.CUSTOM_FIELDS, page_a_line=True)
    assert back.count() == 3000
