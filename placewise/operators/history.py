"""Lists and figures kept for each version; what left a list, and when."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.layers import exists
from .places import MIN_CALLS, MIN_DOORWAYS, RECUR_DAYS

#: The parameters that a list is derived under unless told otherwise. Columns that history keeps by name.
PARAMETERS = {"min_calls": MIN_CALLS, "recur_days": RECUR_DAYS, "min_doorways": MIN_DOORWAYS, "district": None}
KEPT = {
    "address": ("address", "rank", "block", "district", "calls_12mo", "calls_total", "tows", "vehicles_seen", "vehicles_distinct"),
    "block": ("block", "rank", "streets", "district", "doorways", "calls_12mo", "calls_total", "tows", "dwellings"),
}


def parameters_json(parameters: dict | None = None) -> str:
    """Parameters in effect as text that is equal for equal parameters."""
    return json.dumps({**PARAMETERS, **(parameters or {})}, sort_keys=True)


def snapshot_rows(rows: DataFrame, snapshot_id: int, derived_at: str, kind: str | None, key: str = "address") -> DataFrame:
    """Ranked rows of a snapshot, of doorways or blocks (``key``); columns that history does not keep by name go to
    ``detail`` as JSON. ``kind`` is the violation type, or None if the rows name it in ``canonical_type``."""
    front = [c for c in KEPT[key] if c in rows.columns]
    rest = sorted(c for c in rows.columns if c not in (*front, *(("canonical_type",) if kind is None else ())))
    said = F.col("canonical_type") if kind is None else F.lit(kind)
    return rows.select(
        F.lit(snapshot_id).alias("snapshot_id"), F.lit(derived_at).cast("timestamp_ntz").alias("derived_at"), said.alias("violation_type"),
        *front, F.to_json(F.struct(*rest)).alias("detail") if rest else F.lit("{}").alias("detail"),
    )


def version_map(state: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """One row: ``version``, the edit time of each layer as a map, and ``version_json``, the same as text.

    A layer that is asked for but was never seen, or has no edit time, is null in it.
    """
    at = state.groupBy("layer").agg(F.max(F.date_format(F.col("source_last_edit").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")).alias("at"))
    if layers is not None:
        asked = state.sparkSession.createDataFrame([(name,) for name in layers], "layer string")
        at = asked.join(at, "layer", "left")
    pairs = at.agg(F.array_sort(F.collect_list(F.struct("layer", "at"))).alias("pairs"))  # a row per layer
    said = F.transform("pairs", lambda p: F.concat(F.lit('"'), p["layer"], F.lit('":'), F.coalesce(F.concat(F.lit('"'), p["at"], F.lit('"')), F.lit("null"))))
    return pairs.select(F.map_from_entries("pairs").alias("version"), F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}")).alias("version_json"))


def snapshot_headers(
    dimension: DataFrame, snapshot_id: int, derived_at: str, rows: DataFrame, parameters: dict | None = None, version: DataFrame | None = None,
    loaded: DataFrame | None = None,
) -> DataFrame:
    """A header for each type, those with an empty list too: parameters, version (of ``version_map``) and newest call day."""
    types = dimension.filter("status = 'assigned'").select("canonical_type").distinct()
    n = rows.groupBy(F.col("violation_type").alias("canonical_type")).agg(F.count("*").alias("listed"))
    out = types.join(n, "canonical_type", "left")
    if loaded is not None:
        out = out.join(loaded.groupBy("canonical_type").agg(F.max("local").cast("date").alias("latest")), "canonical_type", "left")
    else:
        out = out.withColumn("latest", F.lit(None).cast("date"))
    if version is not None:
        out = out.crossJoin(F.broadcast(version.select("version_json")))  # one row
    else:
        out = out.withColumn("version_json", F.lit(None).cast("string"))
    return out.select(
        F.lit(snapshot_id).alias("snapshot_id"), F.lit(derived_at).cast("timestamp_ntz").alias("derived_at"),
        F.col("canonical_type").alias("violation_type"), F.coalesce("listed", F.lit(0)).alias("listed"),
        F.lit(parameters_json(parameters)).alias("parameters"), F.col("version_json").alias("mirror_version"), F.col("latest").alias("latest_call_date"),
    )


def commit_key(version: str | None, parameters: str) -> str:
    """The name of what is kept for a version and parameters."""
    return hashlib.sha256(f"{version}|{parameters}".encode()).hexdigest()[:20]


def overwrite(rows: DataFrame, path: str) -> None:
    """A part of a commit, in place of what an attempt that was cut short may have left."""
    rows.write.mode("overwrite").parquet(path)


def is_retained(spark: SparkSession, root: str, version: str | None, parameters: str) -> bool:
    return exists(spark, f"{root}/headers/commit={commit_key(version, parameters)}/_SUCCESS")


def retain(headers: DataFrame, doors: DataFrame, blocks: DataFrame, root: str) -> bool:
    """Keep a snapshot of all types under ``root``, unless its version and parameters are kept; whether it was.

    Each part overwrites its own folder, named by version and parameters, and the headers are written last. A snapshot that
    was cut short is not seen by ``retained`` and leaves nothing behind once it is taken again. Without headers nothing is kept.
    """
    spark = headers.sparkSession
    said = headers.select("mirror_version", "parameters").first()  # the same on every header
    if said is None or is_retained(spark, root, said["mirror_version"], said["parameters"]):
        return False
    key = commit_key(said["mirror_version"], said["parameters"])
    for part, rows in (("doorways", doors), ("blocks", blocks), ("headers", headers.coalesce(1))):
        overwrite(rows, f"{root}/{part}/commit={key}")
    return True


def retained(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The ``doorways``, ``blocks`` or ``headers`` of all snapshots whose headers are there."""
    rows = spark.read.parquet(f"{root}/{part}")
    if part != "headers":
        commits = spark.read.parquet(f"{root}/headers").select("commit").distinct()
        rows = rows.join(commits, "commit", "left_semi")
    return rows.drop("commit")


def departed(earlier: DataFrame, later: DataFrame, key: str = "address") -> DataFrame:
    """Keys on the earlier list that the later one lacks."""
    return earlier.join(later.select(key), key, "left_anti").orderBy(key)


def snapshots_of(headers: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Snapshots of a type, oldest first."""
    out = headers.filter(F.col("violation_type") == kind).orderBy("derived_at", "snapshot_id")
    return out if limit is None else out.limit(limit)


def ordinals(headers: DataFrame) -> DataFrame:
    """Headers with ``ord``, a snapshot's number within its type, oldest first: a row per snapshot and type."""
    w = Window.partitionBy("violation_type").orderBy("derived_at", "snapshot_id")
    return headers.withColumn("ord", F.row_number().over(w))


def runs_of(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """``(violation_type, address, first_ord, last_ord)``: the unbroken runs of snapshots that a key is on, from all rows.

    ``numbered`` are headers with ``ord`` (see ``ordinals``). Within a run the number of the snapshot less that of the row stays.
    """
    keys = ["violation_type", "address"]
    on = rows.select("snapshot_id", *keys).distinct().join(numbered.select("snapshot_id", "violation_type", "ord"), ["snapshot_id", "violation_type"])
    island = F.col("ord") - F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))  # a row per snapshot of a key
    return on.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).drop("_island")


def next_runs(runs: DataFrame, rows: DataFrame, ord_: int) -> DataFrame:
    """The runs after one more snapshot, number ``ord_`` of its types, with ``rows``; no older snapshot is read.

    A run that went up to the snapshot before goes on if its key is there, other keys begin one. All else stays as it was.
    Types whose next snapshot has another number are merged apart.
    """
    keys = ["violation_type", "address"]
    now = rows.select(*keys).distinct().withColumn("_now", F.lit(True))
    open_ = runs.filter(F.col("last_ord") == ord_ - 1).join(now, keys, "full_outer")
    went_on = open_.select(
        *keys, F.coalesce("first_ord", F.lit(ord_)).alias("first_ord"), F.when(F.col("_now"), F.lit(ord_)).otherwise(F.col("last_ord")).alias("last_ord")
    )
    return runs.filter(F.col("last_ord") != ord_ - 1).unionByName(went_on)


def presence(headers: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (violation_type, address) and snapshot of the type: ``present``, and the snapshot's ``ord``."""
    numbered = ordinals(headers)
    return presence_in(numbered, runs_of(numbered, rows), asked)


def presence_in(numbered: DataFrame, runs: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``presence``, from runs: those of an asked key, few, are looked up once and told apart by its snapshots' numbers."""
    keys = ["violation_type", "address"]
    held = runs.groupBy(*keys).agg(F.collect_list(F.struct("first_ord", "last_ord")).alias("_runs"))  # changes of one key
    asked = asked.select(*keys).join(held, keys, "left")
    grid = asked.join(numbered, "violation_type")
    present = F.coalesce(F.exists("_runs", lambda r: (r["first_ord"] <= F.col("ord")) & (F.col("ord") <= r["last_ord"])), F.lit(False))
    return grid.select(*keys, "snapshot_id", "derived_at", "ord", present.alias("present"))


def left_when(headers: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The most recent departure of each asked address: status, last snapshot present, first one after without it."""
    numbered = ordinals(headers)
    return left_in(numbered, runs_of(numbered, rows), asked)


def left_in(numbered: DataFrame, runs: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``left_when``, from runs: a key's last run says when it was last there. Numbered headers are a row per snapshot and type."""
    keys = ["violation_type", "address"]
    last = runs.groupBy(*keys).agg(F.max("last_ord").alias("last_present"))
    newest = numbered.groupBy("violation_type").agg(F.max("ord").alias("newest"))
    at = lambda ord_, name: numbered.select("violation_type", ord_.alias("last_present"), F.col("derived_at").alias(name))
    out = asked.join(last, keys, "left").join(newest, "violation_type", "left")
    for when in (at(F.col("ord"), "last_seen_at"), at(F.col("ord") - 1, "left_at")):
        out = out.join(when, ["violation_type", "last_present"], "left")
    status = (
        F.when(F.col("newest").isNull(), "no_snapshots_retained").when(F.col("last_present").isNull(), "never_listed")
        .when(F.col("last_present") == F.col("newest"), "still_listed").otherwise("left")
    )
    return out.select("violation_type", "address", status.alias("status"), "last_seen_at", "left_at")


def figure_rows(record: DataFrame, version: str, parameters: str, stored_at: str, key: str = "canonical_type") -> DataFrame:
    """Figures as they are stored: one row per type, its columns as JSON in ``payload``."""
    rest = sorted(c for c in record.columns if c != key)
    return record.select(
        F.col(key).alias("canonical_type"), F.lit(version).alias("version"), F.lit(parameters).alias("parameters"),
        F.lit(stored_at).cast("timestamp_ntz").alias("stored_at"), F.to_json(F.struct(*rest)).alias("payload"),
    )


FIGURES = "canonical_type string, version string, parameters string, stored_at timestamp_ntz, payload string"


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """All stored figures; none before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], FIGURES)
    return spark.read.schema(FIGURES).parquet(path).select("canonical_type", "version", "parameters", "stored_at", "payload")


def overwrite_figures(rows: DataFrame, path: str) -> int:
    """Each row in a folder of its version, parameters and type, in place of an earlier one; how many there were."""
    key = F.substring(F.sha2(F.concat_ws("|", "version", "parameters"), 256), 1, 20)
    rows = rows.withColumn("commit", key).withColumn("kind", F.md5("canonical_type"))
    watch = Observation()
    rows = rows.repartition("kind").observe(watch, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit", "kind").parquet(path)
    return watch.get["n"] or 0


def store_figures(record: DataFrame, path: str, version: str, parameters: str, stored_at: str) -> int:
    """Store the figures of the types that have none for this version and these parameters; how many were stored.

    A type's figures have a folder of their own, so an attempt that was cut short, or another at the same time, leaves one copy.
    """
    rows = figure_rows(record, version, parameters, stored_at)
    return overwrite_figures(new_figures(rows, read_figures(record.sparkSession, path)), path)


def compute_missing(dimension: DataFrame, path: str, version: str, parameters: str, stored_at: str, make) -> int:
    """Store figures for the assigned types that have none; how many were stored. ``make(types)`` works out the records of
    the given types alone, and is not called if none is missing."""
    types = dimension.filter("status = 'assigned'").select("canonical_type").distinct()
    missing = missing_figures(types, read_figures(dimension.sparkSession, path), version, parameters)
    return 0 if missing.isEmpty() else store_figures(make(missing), path, version, parameters, stored_at)


def missing_figures(types: DataFrame, stored: DataFrame, version: str, parameters: str) -> DataFrame:
    """Types without stored figures for a version and parameters."""
    have = stored.filter((F.col("version") == version) & (F.col("parameters") == parameters)).select("canonical_type")
    return types.join(have, "canonical_type", "left_anti")


def new_figures(figures: DataFrame, stored: DataFrame) -> DataFrame:
    """Figures to append: those whose (version, type, parameters) is not stored."""
    return figures.join(stored.select("version", "canonical_type", "parameters"), ["version", "canonical_type", "parameters"], "left_anti")


def stored_figures(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """The newest payload for each asked (canonical_type, version, parameters), with ``available``."""
    keys = ["canonical_type", "version", "parameters"]
    newest = stored.groupBy(*keys).agg(F.max_by("payload", "stored_at").alias("payload"))
    return asked.join(newest, keys, "left").withColumn("available", F.col("payload").isNotNull())
