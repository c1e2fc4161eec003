"""Decisions on listed items: a validated append-only log and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ("doorway", "block")


def validated(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: a known scope, a key and a decision are needed; a role defaults to 'unspecified', an
    empty note is null. Rejected rows have a ``reason``."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "unknown scope").when(blank("item_key"), "no item")
        .when(blank("decision"), "no decision")
    )
    rows = decisions.withColumn("reason", reason)
    good = rows.filter("reason is null").drop("reason")
    good = good.withColumn("role", F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unspecified")))
    return good.withColumn("note", F.nullif(F.trim("note"), F.lit(""))), rows.filter("reason is not null")


def current(log: DataFrame) -> DataFrame:
    """The latest decision of each (violation_type, scope, item_key)."""
    keys = ["violation_type", "scope", "item_key"]
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "changed_at").alias("d"))
    return last.select(*keys, *[F.col(f"d.{c}").alias(c) for c in rest])


def of_type(state: DataFrame, kind: str) -> DataFrame:
    """Decisions of one type by scope and key; a null note is empty."""
    rows = state.filter(F.col("violation_type") == kind)
    return rows.withColumn("note", F.coalesce("note", F.lit(""))).orderBy("scope", "item_key")
