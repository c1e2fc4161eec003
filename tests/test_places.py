"""Watchlist, recurrence, polygons, history, diffs, freshness, sources and the stream on tiny tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from placewise.operators import figures, freshness, geo, history, places, reconcile, select, triage
from placewise.sources import layers
from placewise.streaming.landing import land_published

CALLS = "object_id long, request_id long, date_initiated timestamp_ntz, date_closed timestamp_ntz, address string, community string, district string, latitude double, longitude double"
T0 = dt.datetime(2024, 5, 1, 12)


def calls_of(spark, rows):
    """rows: (request id, days after T0, address, more)"""
    out = []
    for i, days, address, *more in rows:
        m = {"district": "1", "lat": 0.0, "lon": 0.0} | (more[0] if more else {})
        when = None if days is None else T0 + dt.timedelta(days=days)
        out.append((i, i, when, None, address, "c", m["district"], m["lat"], m["lon"]))
    return spark.createDataFrame(out, CALLS)


def fields_of(spark, rows):
    """rows: (request id, {name: value})"""
    flat = [(i * 10 + k, i, k, n, v) for i, d in rows for k, (n, v) in enumerate({"Alleged Violation": "x", **d}.items())]
    return spark.createDataFrame(flat, "object_id long, request_id long, field_id long, name string, value string")


def doors(spark, rows, attrs=None, **kw):
    fields = fields_of(spark, attrs or [(r[0], {}) for r in rows])
    return {r.address: r for r in places.doorways(select.load(calls_of(spark, rows), fields), **({"min_calls": 1} | kw)).collect()}


def test_recurrence_edges_are_floored_days(spark):
    got = doors(spark, [(1, 0, "a st"), (2, 90.99, "a st"), (3, 0, "b st"), (4, 91, "b st"), (5, 0, "c st"), (6, 1, "c st"), (7, 2, "c st")], recur_days=90)
    assert {a: r.repeat_calls for a, r in got.items()} == {"A ST": 1, "B ST": 0, "C ST": 2}
    assert got["A ST"].median_gap_days == 90 and got["C ST"].vehicles_seen == 0


def test_recency_is_inclusive_and_anchored_on_the_selection(spark):
    got = doors(spark, [(1, 0, "a st"), (2, -0.001, "b st"), (3, 365, None)])
    assert list(got) == ["A ST"] and got["A ST"].calls_12mo == 1


def test_ranks_and_ties(spark):
    attrs = [(i, {"Vehicle Was Towed": "Y" if i == 5 else "N", "Property Ownership": o}) for i, o in [(1, None), (2, "own"), (3, "p"), (4, "q"), (5, None), (6, None)]]
    got = doors(spark, [(2, 0, "b st"), (1, 1, "b st"), (3, 0, "a st", {"district": None}), (4, 0, "a st", {"district": "2"}), (5, 0, "c st"), (6, 1, "c st")], attrs)
    assert {a: r["rank"] for a, r in got.items()} == {"B ST": 1, "A ST": 2, "C ST": 3}
    assert got["B ST"].owner == "own" and got["A ST"].owner == "p" and got["C ST"].owner is None
    assert got["A ST"].district == "2" and got["C ST"].tow_rate == 0.5


def test_zero_coordinates_are_missing(spark):
    got = doors(spark, [(1, 0, "a st", {"lat": 44.0, "lon": 0.0}), (2, 0, "a st", {"lat": 46.0, "lon": -63.0}), (3, 1, "b st")])
    assert (got["A ST"].lat, got["A ST"].lon, got["B ST"].lat) == (45.0, -63.0, None)


def square(x, y, side):
    x, y = float(x), float(y)
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


@pytest.fixture(scope="module")
def donut(spark):
    rings = [("1", [square(0, 0, 10), square(2, 2, 6), square(4, 4, 2)[::-1]]), ("2", [square(20, 0, 5)]), ("0", [square(21, 1, 1)])]
    areas = spark.createDataFrame(rings, "dauid string, rings array<array<array<double>>>")
    return areas.select("dauid", "rings", F.lit(100).alias("dwellings"), *geo.box_of(F.col("rings"))), geo.polygon_edges(areas)


def test_points_in_polygons(spark, donut):
    pts = {"ring": (1.0, 1.0), "hole": (3.0, 3.0), "island": (5.0, 5.0), "outside": (15.0, 5.0), "two": (21.5, 1.5), "one": (24.0, 4.0)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "point string, lon double, lat double")
    got = {r.point: r.block for r in geo.containing_area(df, geo.cover(*donut)).collect()}
    assert got == {"ring": "1", "hole": None, "island": "1", "outside": None, "two": "0", "one": "2"}


def test_blocks_and_neighbours(spark, donut):
    rows = [(i, 0, a, {"lat": 1.0, "lon": x}) for i, a, x in [(1, "1 oak st", 1.0), (2, "2 oak st", 1.0), (3, "3 elm st", 1.0), (4, "9 elm st", 20.5), (5, "8 elm st", 24.0), (6, "1 far st", 15.0)]]
    loaded = select.load(calls_of(spark, rows), fields_of(spark, [(r[0], {}) for r in rows]))
    d = places.doorways(loaded, geo.cover(*donut, carry=["dwellings"]), min_calls=1)
    b = places.blocks(d)
    got = [(r.block, r.doorways, r.streets, r.calls_per_1k_dwellings, r.worst_doorway) for r in b.orderBy("rank").collect()]
    assert got == [("1", 3, "OAK ST / ELM ST", 30.0, "1 OAK ST"), ("2", 2, "ELM ST", 20.0, "9 ELM ST")]
    nb = {r.address: r.block_doorways_calling for r in places.with_neighbours(d, b).collect()}
    assert nb["1 OAK ST"] == 3 and nb["1 FAR ST"] == 1


def test_all_types_equal_one_type(spark):
    rows = [(i, i % 17, f"{i % 5} st") for i in range(60)]
    loaded = select.load(calls_of(spark, rows), fields_of(spark, [(r[0], {}) for r in rows])).withColumn("kind", (F.col("request_id") % 2).cast("string"))
    both = places.doorways(loaded, by=["kind"], min_calls=1)
    for k in "01":
        one = places.doorways(loaded.filter(F.col("kind") == k), min_calls=1)
        assert sorted(map(tuple, both.filter(F.col("kind") == k).select(*one.columns).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert places.doorways(loaded.limit(0)).count() == 0


def test_opposite_patterns_and_bootstrap(spark):
    t = [(f"d{i:03}", 10, 9, 10, 1) for i in range(40)]
    df = spark.createDataFrame(t, "door string, tn long, tr long, nn long, nr long")
    r = figures.tow_verdict(figures.effect_bound(df, replicates=100)).first()
    assert r.comparable and r.tow_verdict == "tow_higher" and r.boot_lo == r.boot_hi == 80.0
    assert figures.tow_verdict(figures.effect_bound(df.limit(1), replicates=20)).first().tow_verdict == "sample_too_small"
    none = figures.effect_bound(df.limit(0), replicates=5).first()
    assert not none.comparable and none.boot_lo is None
    one = spark.createDataFrame([("a", 40, 40, 0, 0), ("b", 0, 0, 40, 20)], "door string, tn long, tr long, nn long, nr long")
    a, b = (figures.cluster_bootstrap(one.repartition(n), replicates=50).first() for n in (1, 7))
    assert a == b and a.replicates < 50


def test_vehicle_verdicts(spark):
    df = spark.createDataFrame([(29, 29), (100, 90), (100, 70), (100, 80)], "seen long, distinct long")
    assert [r.vehicle_verdict for r in figures.vehicle_verdict(df).collect()] == ["sample_too_small", "mostly_distinct", "substantial_repeat", "mixed"]


def test_departures(spark):
    heads = spark.createDataFrame([(i, dt.datetime(2024, 1, i), "k") for i in (1, 2, 3)], "snapshot_id int, derived_at timestamp_ntz, violation_type string")
    rows = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (1, "k", "b"), (3, "k", "b"), (1, "k", "c")], "snapshot_id int, violation_type string, address string")
    asked = spark.createDataFrame([("k", a) for a in "abcd"] + [("other", "a")], "violation_type string, address string")
    got = {(r.violation_type, r.address): (r.status, r.left_at and r.left_at.day) for r in history.left_when(heads, rows, asked).collect()}
    assert got == {("k", "a"): ("left", 3), ("k", "b"): ("still_listed", None), ("k", "c"): ("left", 2), ("k", "d"): ("never_listed", None), ("other", "a"): ("no_snapshots_retained", None)}


def test_diffs(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "p", None), (3, "q", "y")], "k int, u string, v string")
    b = spark.createDataFrame([(1, None, "x"), (2, "p", "z"), (4, "q", "y")], "k int, u string, v string")
    got = sorted(map(tuple, reconcile.row_diff(a, b, ["k"], ["u", "v"]).collect()), key=str)
    assert got == [(2, "changed", "v", None, "z"), (3, "only_a", None, None, None), (4, "only_b", None, None, None)]
    assert reconcile.clean_verdict(reconcile.row_diff(a, a, ["k"], ["u", "v"])).first().clean
    la = spark.createDataFrame([("a", 1, 5), ("b", 2, 4), ("c", 3, 3)], "address string, rank int, n int")
    lb = spark.createDataFrame([("c", 1, 3), ("a", 2, 5), ("d", 3, 1)], "address string, rank int, n int")
    kinds = sorted(tuple(r)[:2] for r in reconcile.list_diff(la, lb, "address", ["n"]).collect())
    assert kinds == [("a", "reordered"), ("b", "missing"), ("c", "reordered"), ("d", "extra")]


def test_renumbering_verdicts(spark):
    mk = lambda *rows: spark.createDataFrame(list(rows), "business_key string, object_id long")
    v = lambda a, b: reconcile.renumbering(a, b).first().verdict
    old = mk(("a", 1), ("b", 2))
    assert [v(old, old), v(old, mk(("a", 3), ("b", 4))), v(old, mk(("a", 1), ("b", 4))), v(old, mk(("z", 1)))] == ["preserved", "reassigned", "partially_reassigned", "no_shared_keys"]


def test_next_update_grace(spark):
    due = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    for now, want in (("2024-01-02 00:00:00", (True, False, None)), ("2024-01-02 00:00:01.5", (True, True, 1))):
        s = freshness.next_update(due, F.lit(None).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"), F.lit(True))
        assert tuple(spark.range(1).select(s["due_passed"], s["overdue"], s["seconds_overdue"]).first()) == want
    s = freshness.next_update(due, due, F.lit("2024-02-01").cast("timestamp_ntz"), F.lit(True))
    assert not spark.range(1).select(s["overdue"]).first()[0]


def test_estimate_needs_two_intervals(spark):
    at = [dt.datetime(2024, 1, d) for d in (1, 8, 18)]
    df = spark.createDataFrame([("a", x) for x in at] + [("b", x) for x in at[:2]], "layer string, edited_at timestamp_ntz")
    got = {r.layer: r for r in freshness.source_estimate(freshness.source_intervals(df), "2024-01-26 12:00:01").collect()}
    assert got["a"].estimated_next == dt.datetime(2024, 1, 26, 12) and got["a"].passed and got["a"].median_days == 8.5 and not got["b"].known


def test_decisions(spark):
    rows = [("t", "doorway", "a", "ok", " ", "", 1), ("t", "doorway", "a", "no", "lead", "n", 2), ("t", "street", "a", "ok", None, None, 3), ("t", "block", "", "ok", None, None, 4)]
    good, bad = triage.validated(spark.createDataFrame(rows, "violation_type string, scope string, item_key string, decision string, role string, note string, changed_at int"))
    assert [r.reason for r in bad.collect()] == ["unknown scope", "no item"]
    assert good.filter("changed_at = 1").first().role == "unspecified" and triage.current(good).first().decision == "no"


def test_pages_to_rows(spark, tmp_path):
    page = {"features": [{"attributes": {"REQUEST_ID": 7, "ObjectId": 1, "DATE_INITIATED": 1700000000000, "ADDRESS": "1 A ST", "DISTRICT": "8", "LATITUDE": 44.6}}]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    r = layers.service_request_rows(layers.read_feature_pages(spark, str(tmp_path / "p.json"), layers.SERVICE_REQUESTS)).first()
    assert (r.object_id, r.request_id, r.address, r.district, r.date_closed, r.longitude) == (1, 7, "1 A ST", "8", None, None)
    area = {"features": [{"attributes": {"OBJECTID": 1, "DAUID": "x"}, "geometry": {"rings": [square(0, 1, 2)]}}, {"attributes": {"OBJECTID": 2, "DAUID": "y"}}]}
    (tmp_path / "a.json").write_text(json.dumps(area))
    got = [tuple(r) for r in layers.census_rows(layers.read_feature_pages(spark, str(tmp_path / "a.json"), layers.CENSUS_AREAS)).select("dauid", "min_lon", "max_lat").collect()]
    assert got == [("x", 0.0, 3.0), ("y", None, None)]
    bad = {"features": [{"attributes": {"REQUEST_ID": None, "ObjectId": 1}}]}
    (tmp_path / "b.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="REQUEST_ID"):
        layers.service_request_rows(layers.read_feature_pages(spark, str(tmp_path / "b.json"), layers.SERVICE_REQUESTS)).collect()


def test_snapshots_lists_and_stream(spark, tmp_path):
    store, landing = f"{tmp_path}/store", tmp_path / "in"
    landing.mkdir()

    def publish(version, n, said):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/v{version}")
        (landing / f"{version}-{n}-{said}.json").write_text(json.dumps({"layer": "calls", "version": version, "rows": said, "folder": f"{tmp_path}/v{version}"}))
        land_published(spark, str(landing), store, f"{tmp_path}/cp")
        return layers.current_version(spark, f"{store}/calls"), layers.read_snapshot(spark, f"{store}/calls").count()

    assert publish("2024-02", 5, 5) == ("2024-02", 5)
    assert publish("2024-01", 9, 9) == ("2024-02", 5)  # older
    assert publish("2024-03", 7, 8) == ("2024-02", 5)  # incomplete
    assert publish("2024-03", 8, 8) == ("2024-03", 8)
    rows = spark.createDataFrame([("No Stopping", "1 A ST", 2)], "canonical_type string, address string, n int")
    layers.write_list(rows, f"{tmp_path}/list")
    assert layers.read_list(spark, f"{tmp_path}/list").first().n == "2"
    layers.write_by_type(rows, f"{tmp_path}/by")
    assert (tmp_path / "by" / "slug=no-stopping").is_dir()
    for _ in range(2):
        layers.append_once(rows, f"{tmp_path}/once", ["canonical_type"])
    assert spark.read.parquet(f"{tmp_path}/once").count() == 1


def test_queries_have_twins():
    import __spark_entry__ as entry

    from placewise.plans import oracle, queries

    assert set(oracle.ORACLE_SQL) == set(queries.QUERIES) <= set(entry.queries())
