"""Snapshots and figures are appended once; versions, exports and whole derivations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placewise.operators import derive, geo, history, places, reconcile

from test_places import calls_of, donut, fields_of  # noqa: F401


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("a", "A", "assigned"), ("b", "B", "assigned"), ("c", None, "excluded")], "raw_label string, canonical_type string, status string")


def test_a_version_is_retained_once_with_empty_lists_too(spark, dim, tmp_path):
    doors = spark.createDataFrame([("A", "1 X ST", 1, 3, 4, "q")], "canonical_type string, address string, rank int, calls_12mo int, calls_total int, owner string")
    blocks = spark.createDataFrame([("A", "77", 1, 2, "1 X ST")], "canonical_type string, block string, rank int, doorways int, worst_doorway string")
    state = spark.createDataFrame([("calls", dt.datetime(2024, 1, 2)), ("fields", None)], "layer string, source_last_edit timestamp")

    def take(i, state, **parameters):
        rows = history.snapshot_rows(doors, i, "2024-01-03", None)
        heads = history.snapshot_headers(dim, i, "2024-01-03", rows, parameters, history.version_map(state, ["calls", "fields", "areas"]))
        return history.retain(heads, rows, history.snapshot_rows(blocks, i, "2024-01-03", None, "block"), f"{tmp_path}/kept")

    assert take(1, state)
    assert not take(2, state)
    assert take(3, state, min_calls=5)
    assert take(4, state.withColumn("source_last_edit", F.lit(dt.datetime(2024, 2, 1))))
    heads = history.retained(spark, f"{tmp_path}/kept", "headers")
    assert sorted((r.snapshot_id, r.violation_type, r.listed) for r in heads.collect()) == [(i, k, n) for i in (1, 3, 4) for k, n in (("A", 1), ("B", 0))]
    first = heads.filter("snapshot_id = 1").first()
    assert first.mirror_version == '{"areas":null,"calls":"2024-01-02T00:00:00","fields":null}' and '"min_calls": 2' in first.parameters
    door, block = (history.retained(spark, f"{tmp_path}/kept", p).filter("snapshot_id = 1").first() for p in ("doorways", "blocks"))
    assert door.detail == '{"owner":"q"}' and block.detail == '{"worst_doorway":"1 X ST"}' and door.violation_type == "A"


def test_figures_are_stored_once(spark, tmp_path):
    record = spark.createDataFrame([("A", 1), ("B", 2)], "canonical_type string, n int")
    path = f"{tmp_path}/figures"
    store = lambda df, version="v": history.store_figures(df, path, version, "{}", "2024-01-01")
    assert [store(record.limit(1)), store(record), store(record), store(record, "w"), store(record.limit(0), "x")] == [1, 1, 0, 2, 0]
    asked = record.select("canonical_type", F.lit("v").alias("version"), F.lit("{}").alias("parameters"))
    got = history.stored_figures(asked, history.read_figures(spark, path))
    assert {r.canonical_type: (r.payload, r.available) for r in got.collect()} == {"A": ('{"n":1}', True), "B": ('{"n":2}', True)}


def derived(spark, donut, **kw):
    at = [(1, "1 oak st", 1.0), (2, "2 oak st", 1.0), (3, "3 elm st", 1.0), (4, "9 elm st", 20.5), (5, "8 elm st", 24.0), (6, "1 far st", 15.0)]
    calls = calls_of(spark, [(i, 0, a, {"lat": 1.0, "lon": x}) for i, a, x in at])
    ids = spark.createDataFrame([(i,) for i in range(1, 9)], "request_id long")
    return derive.derive(calls, fields_of(spark, [(i, {}) for i, _, _ in at]), geo.cover(*donut, carry=["dwellings"]), ids, min_calls=1, **kw)


def test_derive_reports_what_is_missing_and_unplaced(spark, donut):
    d = derived(spark, donut)
    r = d.summary().first()
    assert (r.doorways, r.blocks, r.missing, r.unplaced) == (6, 2, 2, 1)
    nb = {x.address: x.block_doorways_calling for x in d.doorways.collect()}
    assert nb == {x.address: x.block_doorways_calling for x in places.with_neighbours(d.doorways.drop("block_doorways_calling"), d.blocks).collect()}
    assert nb["1 OAK ST"] == 3 and nb["1 FAR ST"] == 1
    nothing = derived(spark, donut, district="none")
    assert nothing.summary().first()[:3] == (0, 0, 0)


def test_exports_have_their_headers_in_order(spark, donut):
    d = derived(spark, donut)
    preamble, doors, blocks = derive.export_lists(d, "A kind", {"district": None, "min_calls": 1})
    assert doors.columns == [*places.DOORWAY_HEADERS.values(), "Violation Type"] and len(doors.columns) == 18
    assert blocks.columns == [*places.BLOCK_HEADERS.values(), "Violation Type"] and len(blocks.columns) == 12
    row = blocks.filter("Block = '1'").first()
    assert row["Addresses"] == "1 Oak St; 2 Oak St; 3 Elm St" and row["Violation Type"] == "A kind"
    said = {r.key: r.value for r in preamble.collect()}
    assert (said["slug"], said["doorway_count"], said["filter: district"], said["filters_in_effect"]) == ("a-kind", "6", None, "min_calls = 1")


def test_run_metadata(spark):
    runs = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None, True), ("a", dt.datetime(2024, 1, 2), None, None), ("b", dt.datetime(2024, 1, 1), "x", True)],
                                 "layer string, started_at timestamp, error string, reconciled boolean")
    state = spark.createDataFrame([("a", dt.datetime(2024, 1, 5)), ("b", dt.datetime(2024, 1, 4))], "layer string, last_success_at timestamp")
    calls = spark.createDataFrame([(dt.datetime(2024, 1, 3),), (None,)], "date_initiated timestamp")
    one = lambda layers: derive.run_metadata(calls, runs, state, layers, "2024-02-01").first()
    assert (one(["a"]).reconciled, one(["a", "b"]).reconciled, one(["c"]).reconciled) == (True, False, False)
    assert (one(["a", "b"]).last_sync, one(["a"]).newest_call) == (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 3))


def test_spreads_equal_all_pairs(spark):
    import math
    import random

    rnd = random.Random(3)
    rows = []
    for d in range(6):
        for _ in range((1, 2, 3, 40, 200, 200)[d]):
            a = rnd.random() * 2 * math.pi
            r = 0.01 if d == 4 else 0.01 * rnd.random()  # all on a circle, or within it
            rows.append((f"{d} st", 44.65 + r * math.cos(a), -63.0 + r * math.sin(a), "ab"[len(rows) % 2]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "request_id long, address string, latitude double, longitude double, kind string")
    k = math.cos(math.radians(44.65))
    for by in ([], ["kind"]):
        want = {}
        for _, (a, la, lo, kind) in enumerate(rows):
            want.setdefault((kind, a.upper()) if by else (a.upper(),), []).append((lo * 111_320.0 * k, la * 111_320.0))
        got = {tuple(r[: len(by) + 1]): (r.calls, r.spread) for r in geo.spreads(df, by).collect()}
        assert set(got) == set(want)
        for key, pts in want.items():
            assert got[key][0] == len(pts)
            assert got[key][1] == pytest.approx(max(math.dist(p, q) for p in pts for q in pts), abs=1e-6)


def test_lists_are_compared_without_their_clocks(spark):
    rows = [(f"a{i}", i + 1, i * 2, "then") for i in range(50)]
    a = spark.createDataFrame(rows, "address string, rank int, n int, derived_at string")
    b = spark.createDataFrame([(k, r, n, "now") for k, r, n, _ in rows if k not in ("a3", "a40")], "address string, rank int, n int, derived_at string")
    assert {(r.address, r.change) for r in reconcile.list_diff(a, b, "address").collect()} == {("a3", "missing"), ("a40", "missing")}
    assert reconcile.id_diff(a.withColumnRenamed("rank", "request_id"), b.withColumnRenamed("rank", "request_id")).first()[:] == (50, 48, 2, 0)


def test_versions_without_an_edit_time_come_first(spark):
    df = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 2)), ("a", 2, None), ("a", 3, dt.datetime(2024, 1, 1)), ("b", 4, None)], "layer string, version_id int, edited_at timestamp")
    assert [(r.layer, r.version_id, r.position) for r in reconcile.retained_versions(df).collect()] == [("a", 2, 1), ("a", 3, 2), ("a", 1, 3), ("b", 4, 1)]


def test_median_equals_sorting(spark):
    import random
    import statistics

    from placewise.operators import ranking

    rnd = random.Random(5)
    groups = {f"g{n}": [rnd.choice([rnd.random() * 100, 7.5, -40.0, 1e6]) for _ in range(n)] for n in (1, 2, 3, 10, 401, 1000)}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("g3", None)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    assert {r.k: r.v for r in ranking.median(df, "v", ["k"], "n").collect()} == {k: pytest.approx(statistics.median(vs)) for k, vs in groups.items()}
    assert ranking.median(df.filter("k = 'g10'"), "v", [], "n", 0.5).first().v == pytest.approx(statistics.median(groups["g10"]))
    assert ranking.median(df.filter("v is null"), "v", [], "n").first().v is None
    assert ranking.median(df.filter("v is null"), "v", ["k"], "n").count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_ranks_equal_sorting(spark, by):
    import random

    rnd = random.Random(7)
    rows = [("ab"[i % 2], rnd.choice([0.0, 1.5, 1.5, 2.0, 300.0]), rnd.randint(0, 10**6) * 1000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, score double, first_seen long")
    got = {r.first_seen: r["rank"] for r in places.numbered(df, by, [F.negative("score"), F.col("first_seen")]).collect()}
    want = {}
    for k in "ab" if by else [None]:
        group = sorted((r for r in rows if k in (None, r[0])), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: n for n, r in enumerate(group, 1)}
    assert got == want
    assert places.numbered(df.limit(0), by, [F.negative("score"), F.col("first_seen")]).count() == 0
