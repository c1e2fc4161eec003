"""Registered queries of sources and sinks: rows of the given tables are written as layers are published, landed and read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import figures, freshness, geo, history, places, reconcile, versions
from ..sources import layers
from ..streaming.landing import land_published, merge_published
from .adapter import Inputs
from .queries import CUTOFFS, KIND, everything, query, typed


def landed(t: Inputs, published: DataFrame, layer: layers.Layer, order: str) -> DataFrame:
    """The rows written as feature pages and read back."""
    path = layers.work_folder(t.spark, layer.name)
    layers.write_feature_pages(published, layer, path, order)
    return layers.read_feature_pages(t.spark, path, layer, page_a_line=True)


@query
def landed_calls(t):
    c = t.calls
    out = c.select(
        F.col("request_id").alias("REQUEST_ID"), C.epoch_ms(F.col("date_initiated").cast("timestamp")).alias("DATE_INITIATED"),
        C.epoch_ms(F.col("date_closed").cast("timestamp")).alias("DATE_CLOSED"), F.col("object_id").alias("ObjectId"),
        *[F.col(n).alias(n.upper()) for n in ("description", "initiated_by", "priority", "address", "community", "district", "request_category",
                                              "resolution", "latitude", "longitude", "status", "dept_responsibility", "work_order")],
    )
    rows = layers.service_request_rows(landed(t, out, layers.SERVICE_REQUESTS, "REQUEST_ID"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date_initiated", "date_closed")})


@query
def landed_fields(t):
    out = t.fields.select(
        F.col("request_id").alias("REQUESTID"), F.col("field_id").cast("long").alias("CUSTOM_FIELD_ID"), F.col("name").alias("CUSTOM_FIELD_NAME"),
        F.col("value").alias("CUSTOM_FIELD_VALUE"), F.col("object_id").alias("ObjectId"),
    )
    return layers.custom_field_rows(landed(t, out, layers.CUSTOM_FIELDS, "ObjectId"))


def landed_census(t) -> DataFrame:
    """The areas published with rings of points: the outer square, and the hole where there is one; the last area has none."""
    a, b = F.col("x0") + F.col("off"), F.col("y0") + F.col("off")
    corner = lambda i, j: F.array(a + i * F.col("side"), b + j * F.col("side"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    rings = t.squares.groupBy("dauid").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", ring.alias("ring")))), lambda s: s["ring"]).alias("rings"))
    out = rings.join(t.areas.select("dauid", "dwellings"), "dauid").select(
        F.col("dauid").cast("long").alias("OBJECTID"), F.col("dauid").alias("DAUID"), F.lit(None).cast("int").alias("DAPOP2021"),
        F.expr("case when dwellings = 0 then null else dwellings end").cast("int").alias("DATDWELL20"), F.lit(None).cast("int").alias("DAURDWELL2"),
        *[F.lit(None).cast("double").alias(c) for c in ("DAAREA", "DAPOPDEN", "DARPLAT", "DARPLONG")],
        F.concat(F.lit("part "), "dauid").alias("CSDNAME"), F.lit("whole").alias("CDNAME"),
        F.when(F.col("dauid") != "24", F.col("rings")).alias("rings"),
    )
    return layers.census_rows(landed(t, out, layers.CENSUS_AREAS, "OBJECTID"))


@query
def landed_areas(t):
    return landed_census(t).drop("rings")


@query
def scanned_areas(t):
    """The areas as derivations scan them: with geometry, no nulls among the counts."""
    path = layers.work_folder(t.spark, "areas")
    landed_census(t).write.parquet(path)
    return layers.scan_areas(t.spark, path).select("dauid", "dwellings", "people", "min_lon", "min_lat", "max_lon", "max_lat")


@query
def area_edges(t):
    """Edges of the landed rings, the last vertex joined to the first."""
    return geo.polygon_edges(landed_census(t).filter("rings is not null"))


@query
def scanned_calls(t):
    path = layers.work_folder(t.spark, "calls")
    t.calls.write.parquet(path)
    return layers.scan_calls(t.spark, path)


@query
def epoch_times(t):
    """Instants to epoch milliseconds and back; none from an empty text."""
    ms = C.epoch_ms(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 10 == 0, "").otherwise(ms.cast("string"))
    return t.events.select("event_id", ms.alias("ms"), C.epoch_to_utc(text).cast("timestamp_ntz").alias("back"))


@query
def replaced_snapshot(t):
    """Two versions of a layer land, one of them twice; readers get the newer."""
    root = layers.work_folder(t.spark, "runs")
    rows = t.runs.select("run_id", "layer", "started_at")
    for version, part in (("1", rows.filter("layer = 'click'")), ("2", rows.filter("layer <> 'click'")), ("2", rows.filter("layer <> 'click'"))):
        layers.replace_snapshot(t.spark, part, root, version)
    return layers.read_snapshot(t.spark, root)


@query
def landed_stream(t):
    """Published versions arrive as manifests in one batch: the newest is incomplete, the one before is landed."""
    root = layers.work_folder(t.spark, "stream")
    rows = t.runs.select("run_id", "layer", "started_at")
    said = []
    for version, part, short in (("2024-01", "run_id % 2 = 0", 0), ("2024-02", "run_id % 2 = 1", 0), ("2024-03", "run_id % 5 = 0", 1)):
        rows.filter(part).write.parquet(f"{root}/published/{version}")
        said.append(("runs", version, rows.filter(part).count() + short, f"{root}/published/{version}"))
    t.spark.createDataFrame(said, "layer string, version string, rows long, folder string").coalesce(1).write.json(f"{root}/manifests")
    land_published(t.spark, f"{root}/manifests", f"{root}/store", f"{root}/checkpoint")
    return layers.read_snapshot(t.spark, f"{root}/store/runs")


@query
def listed_as_text(t):
    """A ranked list written as CSV and read as text."""
    path = layers.work_folder(t.spark, "list")
    layers.write_list(places.doorways(everything(t)).select("rank", "address", "calls_12mo", "calls_total", "tows", "last_call"), path)
    return layers.read_list(t.spark, path)


@query
def lists_by_type(t):
    path = layers.work_folder(t.spark, "by-type")
    layers.write_by_type(places.doorways(typed(t), by=[KIND]).select(KIND, "rank", "address", "calls_total"), path)
    return layers.read_list(t.spark, path)


@query
def retained_snapshots(t):
    """Two versions of all lists are retained, the second twice; each is kept once."""
    root = layers.work_folder(t.spark, "retained")
    for i, (day, label) in enumerate((("1998-01-01", "view"), ("1999-06-01", "click"), ("1999-06-01", "click")), 1):
        version = history.version_map(t.layer_state.filter(F.col("layer") == label))
        if history.is_retained(t.spark, root, version.first()["version_json"], history.parameters_json()):
            continue  # nothing is derived for a version that is kept
        loaded = typed(t).filter(F.col("local") < F.lit(day).cast("timestamp_ntz"))
        doors = layers.settled(places.doorways(loaded, t.covered, by=[KIND]), "doors")
        rows = history.snapshot_rows(doors.select(KIND, *history.KEPT["address"]), i, day, None)
        blocks = history.snapshot_rows(places.blocks(doors, by=[KIND]).select(KIND, *history.KEPT["block"]), i, day, None, "block")
        history.retain(history.snapshot_headers(t.dim, i, day, rows, version=version), rows, blocks, root)
    return kept_lists(t, root)


def kept_lists(t: Inputs, root: str, *more: str) -> DataFrame:
    """Headers of all kept snapshots with the rows that are kept for them."""
    read = lambda part: history.retained(t.spark, root, part)
    count = lambda part: read(part).groupBy("snapshot_id", "violation_type").agg(F.count("*").alias(part))
    heads = read("headers").select("snapshot_id", "violation_type", "listed", *more)
    out = heads.join(count("doorways"), ["snapshot_id", "violation_type"], "left").join(count("blocks"), ["snapshot_id", "violation_type"], "left")
    return out.fillna(0, ["doorways", "blocks"])


@query
def kept_figures(t):
    """Figures are stored once for each version, type and parameters: a second run of a version adds the type it lacked."""
    path = layers.work_folder(t.spark, "figures")
    record = layers.settled(figures.group_totals(figures.tallies(figures.recurrence_flags(typed(t), by=[KIND]), [KIND]), [KIND]), "record")
    history.store_figures(record.filter(f"{KIND} = 'Urgent or high'"), path, "v1", "{}", "2024-01-01")
    history.store_figures(record.withColumn("tn", F.lit(0)), path, "v1", "{}", "2024-01-02")
    history.store_figures(record, path, "v1", "{}", "2024-01-03")
    return history.read_figures(t.spark, path)


@query
def derived_versions(t):
    """Versions of both call layers arrive; lists and figures are kept for each that both are at. The third lacks a layer."""
    root = layers.work_folder(t.spark, "derived")
    for i, (day, parts) in enumerate(((CUTOFFS[0], 2), (CUTOFFS[1], 2), (CUTOFFS[2], 1)), 1):
        said = []
        for name, rows in (("service_requests", t.calls.filter(F.col("date_initiated") < F.lit(day).cast("timestamp_ntz"))), ("custom_fields", t.fields))[:parts]:
            rows.write.parquet(f"{root}/published/{name}/{i}")
            said.append((name, f"2024-0{i}", t.spark.read.parquet(f"{root}/published/{name}/{i}").count(), f"{root}/published/{name}/{i}"))
        t.spark.createDataFrame(said, "layer string, version string, rows long, folder string").coalesce(1).write.mode("append").json(f"{root}/manifests")
        then = lambda i=i: versions.derive_landed(t.spark, f"{root}/store", t.covered, t.dim, root, f"2024-0{i}-02")
        land_published(t.spark, f"{root}/manifests", f"{root}/store", f"{root}/checkpoint", then)
    kept = history.read_figures(t.spark, f"{root}/figures")
    said = kept.select(F.col("canonical_type").alias("violation_type"), F.col("version").alias("mirror_version"), F.from_json("payload", "tn long, closed long, selection long, labels array<struct<label string, requests long>>").alias("f"))
    lists = kept_lists(t, f"{root}/lists", "mirror_version")
    return lists.join(said, ["violation_type", "mirror_version"], "left").select(*lists.columns, "f.tn", "f.closed", "f.selection", F.size("f.labels").alias("labels"))


def deltas_of(t) -> tuple[DataFrame, list[DataFrame]]:
    """The attributes as they were first, then corrected texts and new rows, and older rows that change nothing but where none is."""
    fields = t.fields.withColumn("written", F.lit(2))
    again = fields.filter("request_id % 1000 < 100").withColumn("value", F.upper("value")).withColumn("written", F.lit(3))
    stale = fields.filter("request_id % 7 = 0").withColumn("value", F.lit("stale")).withColumn("written", F.lit(1))
    return fields, [fields.filter("request_id % 5 <> 0"), again, stale]


@query
def merged_deltas(t):
    """The attributes land in a keyed table, then two deltas."""
    fields, deltas = deltas_of(t)
    held = layers.KeyedTable(t.spark, layers.work_folder(t.spark, "keyed"), fields.schema, "object_id", "written", width=10_000)
    for delta in deltas:
        held.merge(delta)
    return held.read()


@query
def streamed_deltas(t):
    """The same deltas as files that a stream merges, the last after the others."""
    root = layers.work_folder(t.spark, "deltas")
    fields, deltas = deltas_of(t)
    held = layers.KeyedTable(t.spark, f"{root}/held", fields.schema, "object_id", "written", width=10_000)
    for at in ([0, 1], [2]):
        for i in at:
            deltas[i].write.parquet(f"{root}/published/{i}")
        merge_published(t.spark, f"{root}/published", held, f"{root}/checkpoint")
    return held.read()


@query
def kept_samples(t):
    """Samples of two versions are kept, one of them twice."""
    path = layers.work_folder(t.spark, "samples")
    for day in (CUTOFFS[0], CUTOFFS[1], CUTOFFS[1]):
        calls = t.calls.filter(F.col("date_initiated") < F.lit(day).cast("timestamp_ntz"))
        layers.keep_sample(reconcile.version_sample("service_requests", calls, day), path)
    return layers.read_samples(t.spark, path)


@query
def footer_identity(t):
    """Row count, highest object id and newest call of the stored calls, from file footers."""
    path = layers.work_folder(t.spark, "counted")
    layers.write_counted(t.calls.select(*layers.CALL_COLUMNS), path)
    calls = layers.read_counted(t.spark, path)
    return reconcile.version_identity(calls).crossJoin(F.broadcast(freshness.newest_call(calls, "date_initiated" + layers.MICROS)))  # one row each


@query
def footer_counts(t):
    """Layers whose stored rows, counted from file footers, are not as many as were published."""
    path = layers.work_folder(t.spark, "stored")
    layers.write_counted(t.runs.filter("layer <> 'click' or run_id % 2 = 0").select("run_id", "layer", "started_at"), path, "layer")
    published = t.runs.groupBy("layer").agg(F.count("*").alias("published"))
    found = reconcile.count_check(reconcile.stored_counts(layers.read_counted(t.spark, path)), published)
    return found.select("layer", "kind", F.col("detail")["stored"].alias("stored"), F.col("detail")["published"].alias("published"))
