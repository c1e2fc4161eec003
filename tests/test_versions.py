"""A landed version's lists and figures are kept once, wherever an attempt is cut short."""

import json

import pytest
from pyspark.sql import functions as F

from placewise.operators import figures, geo, history, places, versions
from placewise.sources import layers
from placewise.streaming.landing import land_published

from test_places import calls_of, donut, fields_of  # noqa: F401


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("x", "A", "assigned"), ("y", "B", "assigned"), ("z", None, "excluded")], "raw_label string, canonical_type string, status string")


class Cut(Exception):
    pass


def world(spark, tmp_path, donut):
    calls = calls_of(spark, [(i, i % 3 * 5, f"{i % 4} oak st", {"lat": 1.0, "lon": 1.0 + i % 4}) for i in range(1, 30)])
    fields = fields_of(spark, [(i, {"Alleged Violation": "x" if i % 2 else "y", "Vehicle Was Towed": "YN"[i % 2]}) for i in range(1, 30)])
    covered = geo.cover(*donut, carry=["dwellings"])
    landing = tmp_path / "in"
    landing.mkdir()

    def publish(layer, version, rows, said=None):
        folder = f"{tmp_path}/published/{layer}/{version}"
        rows.write.parquet(folder)
        (landing / f"{layer}-{version}.json").write_text(json.dumps({"layer": layer, "version": version, "rows": rows.count() if said is None else said, "folder": folder}))

    return calls, fields, covered, str(landing), publish


def told(spark, root):
    """Everything that is kept, without clocks and folder names."""
    out = {}
    for part in ("headers", "doorways", "blocks"):
        out[part] = sorted(map(str, history.retained(spark, f"{root}/lists", part).collect()))
    out["figures"] = sorted(map(str, history.read_figures(spark, f"{root}/figures").drop("stored_at").collect()))
    return out


def test_a_batch_that_fails_anywhere_is_done_over_once(spark, tmp_path, donut, dim, monkeypatch):
    calls, fields, covered, landing, publish = world(spark, tmp_path, donut)
    monkeypatch.setattr(figures, "REPLICATES", 20)
    monkeypatch.setattr(figures.type_record, "__defaults__", (2, 20, "canonical_type"))
    publish("service_requests", "2024-01", calls)
    publish("custom_fields", "2024-01", fields)
    writes = {"n": 0, "fail": None}
    real_overwrite, real_figures = history.overwrite, history.overwrite_figures

    def counted(real):
        def run(rows, path):
            writes["n"] += 1
            if writes["n"] == writes["fail"]:
                raise Cut
            out = real(rows, path)
            if writes["fail"] is not None and writes["n"] == writes["fail"] - 0.5:
                raise Cut
            return out

        return run

    monkeypatch.setattr(history, "overwrite", counted(real_overwrite))
    monkeypatch.setattr(history, "overwrite_figures", counted(real_figures))

    def run(root):
        then = lambda: versions.derive_landed(spark, f"{root}/store", covered, dim, root, "2024-02-01")
        land_published(spark, landing, f"{root}/store", f"{root}/cp", then)

    run(f"{tmp_path}/good")
    want, total = told(spark, f"{tmp_path}/good"), writes["n"]
    assert total == 4 and len(want["headers"]) == len(want["figures"]) == 2
    for fail in range(1, total + 1):
        root = f"{tmp_path}/cut{fail}"
        writes.update(n=0, fail=fail)
        with pytest.raises(Exception, match="Cut"):
            run(root)
        assert layers.current_version(spark, f"{root}/store/service_requests") == "2024-01"
        writes.update(n=0, fail=None)
        run(root)  # the same batch again
        assert told(spark, root) == want
        run(root)  # nothing new
        assert told(spark, root) == want


def test_only_versions_that_both_layers_are_at(spark, tmp_path, donut, dim, monkeypatch):
    calls, fields, covered, landing, publish = world(spark, tmp_path, donut)
    monkeypatch.setattr(figures.type_record, "__defaults__", (2, 20, "canonical_type"))
    root, seen = f"{tmp_path}/out", []
    then = lambda: seen.append(versions.derive_landed(spark, f"{root}/store", covered, dim, root, "2024-02-01", {"recur_days": 1}))
    publish("service_requests", "2024-01", calls)
    land_published(spark, landing, f"{root}/store", f"{root}/cp", then)
    publish("custom_fields", "2024-01", fields)
    land_published(spark, landing, f"{root}/store", f"{root}/cp", then)
    publish("service_requests", "2024-02", calls.filter("request_id < 9"))
    publish("custom_fields", "2024-02", fields, said=10**6)  # incomplete
    land_published(spark, landing, f"{root}/store", f"{root}/cp", then)
    assert seen == [None, "2024-01", None]
    heads = history.retained(spark, f"{root}/lists", "headers").collect()
    assert {json.loads(h.parameters)["recur_days"] for h in heads} == {1} and {h.snapshot_id for h in heads} == {1}
    # The lists that the headers describe were derived under their parameters.
    loaded = versions.select.load(calls, fields).join(versions.select.canonical_types(fields, dim), "request_id")
    lists = places.doorways(loaded, covered, recur_days=1, by=["canonical_type"])
    want = {(r.canonical_type, r.address): r.repeat_calls for r in lists.collect()}
    kept = history.retained(spark, f"{root}/lists", "doorways")
    assert {(r.violation_type, r.address): json.loads(r.detail)["repeat_calls"] for r in kept.collect()} == want
    assert want != {(r.canonical_type, r.address): r.repeat_calls for r in places.doorways(loaded, covered, by=["canonical_type"]).collect()}


def test_defaults_have_one_source(spark):
    said = json.loads(history.parameters_json())
    assert (said["recur_days"], said["min_calls"], said["min_doorways"]) == (places.RECUR_DAYS, places.MIN_CALLS, places.MIN_DOORWAYS) == (365, 2, 2)
    assert places.doorways.__defaults__[1:3] == (2, 365)


def test_only_missing_figures_are_worked_out(spark, tmp_path, dim):
    path, asked = f"{tmp_path}/figures", []

    def make(types):
        asked.append(sorted(r[0] for r in types.collect()))
        return types.withColumn("n", F.lit(len(asked)))

    record = spark.createDataFrame([("B", 7)], "canonical_type string, n int")
    assert history.store_figures(record, path, "v", "{}", "2024-01-01") == 1
    assert [history.compute_missing(dim, path, "v", "{}", "2024-01-02", make) for _ in range(2)] == [1, 0]
    assert history.compute_missing(dim, path, "w", "{}", "2024-01-02", make) == 2 and asked == [["A"], ["A", "B"]]
    got = {(r.version, r.canonical_type): r.payload for r in history.read_figures(spark, path).collect()}
    assert got == {("v", "A"): '{"n":1}', ("v", "B"): '{"n":7}', ("w", "A"): '{"n":2}', ("w", "B"): '{"n":2}'}


def test_figures_of_types_hold_response_time_and_denominators(spark, donut, dim):
    calls = calls_of(spark, [(i, i, "1 oak st") for i in range(1, 6)])
    fields = fields_of(spark, [(i, {"Alleged Violation": "x" if i < 4 else "y", "Vehicle Was Towed": "Y"}) for i in range(1, 6)])
    loaded = versions.select.load(calls, fields).join(versions.select.canonical_types(fields, dim), "request_id")
    types = dim.filter("canonical_type = 'A'").select("canonical_type")
    row = versions.all_figures(loaded, fields, types, history.PARAMETERS).collect()
    assert len(row) == 1
    assert (row[0].selection, row[0].tow_cohort, row[0].never_closed, row[0].closed) == (3, 3, 3, 0)
    assert [(x.label, x.requests) for x in row[0].labels] == [("x", 3)] and row[0].tn == 3
