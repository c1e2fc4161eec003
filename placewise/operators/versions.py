"""From a landed version to its lists and figures, each kept exactly once for the version and the parameters in effect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layers import current_version, read_snapshot, settled
from . import figures, history, places, select

#: The layers that calls are made of.
CALL_LAYERS = ("custom_fields", "service_requests")
KEY = "canonical_type"


def agreed_version(spark: SparkSession, store: str, layers: tuple[str, ...] = CALL_LAYERS) -> str | None:
    """The version that all of the layers are at; None if one is missing or they differ."""
    found = {current_version(spark, f"{store}/{layer}") for layer in layers}
    return found.pop() if len(found) == 1 else None


def snapshot_version(
    loaded: DataFrame, covered: DataFrame, dimension: DataFrame, version: str, root: str, derived_at: str, parameters: dict | None = None,
    busy: DataFrame | None = None,
) -> bool:
    """Derive and keep the lists of all types (``loaded`` has their ``canonical_type``), unless they are kept; whether it was.

    Headers say the parameters that the lists were derived under. Nothing is derived for a version that is kept.
    """
    spark, said = loaded.sparkSession, {**history.PARAMETERS, **(parameters or {})}
    if history.is_retained(spark, root, version, history.parameters_json(said)):
        return False
    taken = history.retained(spark, root, "headers").select("snapshot_id").distinct().count() if history.exists(spark, f"{root}/headers") else 0
    doors = places.doorways(loaded, covered, said["min_calls"], said["recur_days"], by=[KEY], district=said["district"], busy=busy)
    doors = settled(doors, "doors")
    blocks = places.blocks(doors, said["min_doorways"], by=[KEY])
    kept = lambda rows, key: history.snapshot_rows(rows, taken + 1, derived_at, None, key)
    rows = kept(doors.drop("first_seen"), "address")
    name = spark.createDataFrame([(version,)], "version_json string")
    return history.retain(history.snapshot_headers(dimension, taken + 1, derived_at, rows, said, name, loaded), rows, kept(blocks, "block"), root)


def all_figures(loaded: DataFrame, fields: DataFrame, types: DataFrame, parameters: dict, as_of: str | None = None, busy: DataFrame | None = None) -> DataFrame:
    """The record of each of the given types: recurrence, vehicles, response time and denominators. Only their calls are read."""
    loaded = loaded.join(F.broadcast(types), KEY, "left_semi")  # a row per type
    measures = places.door_measures(loaded, parameters["recur_days"], by=[KEY], busy=busy)
    asked = types.select(KEY, F.lit("assigned").alias("status"))
    out = figures.type_record(measures, asked, parameters["min_calls"], key=KEY)
    out = out.join(figures.response_time(loaded, as_of, [KEY]), KEY, "left")
    out = out.join(figures.denominators_by(loaded, fields, KEY, as_of), KEY, "left")
    return out.fillna(0, ["closed", "never_closed", "selection", "as_of", "tow_cohort", "known_status", "excluded"])


def derive_landed(
    spark: SparkSession, store: str, covered: DataFrame, dimension: DataFrame, root: str, derived_at: str, parameters: dict | None = None,
) -> str | None:
    """Keep lists and figures of the landed version under ``root``, once; the version, or None if the call layers disagree.

    It may be run again at any time: what is kept is left alone, what an attempt left half done is done over.
    """
    at = agreed_version(spark, store)
    if at is None:
        return None
    said = {**history.PARAMETERS, **(parameters or {})}
    version = json.dumps(dict.fromkeys(CALL_LAYERS, at), sort_keys=True, separators=(",", ":"))
    calls, fields = read_snapshot(spark, f"{store}/service_requests"), read_snapshot(spark, f"{store}/custom_fields")
    loaded = select.load(calls, fields).join(select.canonical_types(fields, dimension), "request_id")
    # Written, since lists, headers and each of the figures are made of it.
    loaded = settled(loaded.select(KEY, *places.MEASURED, "date_initiated", "date_closed"), "loaded")
    found = select.busy_doors(calls)
    busy = None if found.isEmpty() else settled(found, "busy")
    snapshot_version(loaded, covered, dimension, version, f"{root}/lists", derived_at, said, busy)
    make = lambda types: all_figures(loaded, fields, types, said, busy=busy)
    history.compute_missing(dimension, f"{root}/figures", version, history.parameters_json(said), derived_at, make)
    return at
