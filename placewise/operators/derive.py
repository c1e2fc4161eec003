"""A whole derivation from one selection: both lists, what the selection lacks, and the clocks of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places, reconcile, select
from .places import MIN_CALLS, MIN_DOORWAYS, RECENCY_DAYS, RECUR_DAYS


@dataclass(frozen=True)
class Derived:
    """The selection's calls and the lists made of them; all are lazy."""

    loaded: DataFrame
    doorways: DataFrame
    blocks: DataFrame
    missing: DataFrame
    latest: DataFrame

    def summary(self) -> DataFrame:
        """One row: doorways, blocks, doorways without a block, selected ids without a call, the newest call."""
        doors = self.doorways.agg(F.count("*").alias("doorways"), F.count_if(F.col("block").isNull()).alias("unplaced"))
        parts = (self.blocks.agg(F.count("*").alias("blocks")), self.missing.agg(F.count("*").alias("missing")), self.latest)
        for part in parts:
            doors = doors.crossJoin(F.broadcast(part))  # one row each
        return doors


def derive(
    calls: DataFrame, fields: DataFrame, covered: DataFrame, ids: DataFrame | None = None, min_calls: int = MIN_CALLS,
    recur_days: int = RECUR_DAYS, recency_days: int = RECENCY_DAYS, min_doorways: int = MIN_DOORWAYS, district: str | None = None,
    busy: DataFrame | None = None,
) -> Derived:
    """The lists of the calls in ``ids`` (all if None): doorways of a district with their neighbours, and blocks.

    A selected id without a call is reported as missing, a listed doorway in no area as one without a block.
    """
    loaded = select.load(calls, fields, ids)
    doors = places.doorways(loaded, covered, min_calls, recur_days, recency_days, district=district, busy=busy)
    blocks = places.blocks(doors, min_doorways)
    missing = select.missing_ids(ids, calls) if ids is not None else calls.select("request_id").limit(0)
    return Derived(loaded, places.neighbours(doors, min_doorways), blocks, missing, loaded.agg(F.max("local").alias("latest")))


def run_metadata(calls: DataFrame, runs: DataFrame, state: DataFrame, layers: list[str], derived_at: str) -> DataFrame:
    """One row: ``derived_at``, the last successful sync, the newest call, and whether every layer of ``layers`` agreed
    with its source when last compared."""
    asked = state.sparkSession.createDataFrame([(name,) for name in layers], "layer string")
    agreed = reconcile.all_reconciled(reconcile.reconciled(runs, asked))
    synced = state.filter(F.col("layer").isin(layers)).agg(F.min("last_success_at").alias("last_sync"))
    newest = calls.agg(F.max("date_initiated").alias("newest_call"))
    out = newest.crossJoin(F.broadcast(synced)).crossJoin(F.broadcast(agreed))  # one row each
    return out.select(F.lit(derived_at).cast("timestamp_ntz").alias("derived_at"), "last_sync", "newest_call", "reconciled")


def export_lists(derived: Derived, kind: str, filters: dict[str, object]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Preamble, doorways and blocks of one type's export, under the filters that it was derived with."""
    preamble = places.export_preamble(derived.doorways, derived.blocks, derived.latest, kind, filters)
    return preamble, places.export_doorways(derived.doorways, kind), places.export_blocks(derived.blocks, kind)
