"""Freshness of stores of layers: whose limit a lag is, what is due next. One row per layer or store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days until a newest call is stale, days of grace after the due time, intervals an estimate needs.
STALE_DAYS = 21
GRACE_DAYS = 1
LEAST_INTERVALS = 2
DAY_SECONDS = 86_400


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1_000_000


def layer_freshness(state: DataFrame, pulled: DataFrame) -> DataFrame:
    """Layer clocks with ``behind`` (the source has an edit that was not pulled) and ``limit`` (whose it is)."""
    both = state.join(pulled, "layer", "left")
    behind = F.coalesce(F.col("source_last_edit") > F.col("pulled"), F.col("source_last_edit").isNotNull())
    limit = F.when(F.col("static"), "static").when(behind, "this_system").otherwise("source")
    return both.select("store", "layer", "static", "source_last_edit", "pulled", "last_success_at", "last_attempt_at", "next_due_at",
                       "full_load_completed_at", (behind & ~F.col("static")).alias("behind"), limit.alias("limit"))


def store_freshness(layers: DataFrame) -> DataFrame:
    """Per store, static layers aside: earliest success, latest attempt, earliest due time, any layer behind."""
    moving = layers.filter("not static")
    return moving.groupBy("store").agg(
        F.min("last_success_at").alias("last_success_at"), F.max("last_attempt_at").alias("last_attempt_at"),
        F.min("next_due_at").alias("next_due_at"), F.bool_or("behind").alias("behind"),
    )


def readiness(layers: DataFrame) -> DataFrame:
    """Per store: uninitialised (no load completed), not_ready (some) or ready (all)."""
    n = layers.groupBy("store").agg(F.count_if(F.col("full_load_completed_at").isNotNull()).alias("loaded"), F.count("*").alias("layers"))
    said = F.when(F.col("loaded") == 0, "uninitialised").when(F.col("loaded") < F.col("layers"), "not_ready").otherwise("ready")
    return n.select("store", "loaded", "layers", said.alias("readiness"))


def newest_call(calls: DataFrame, micros: str | None = None) -> DataFrame:
    """The newest date; from the column of its microseconds, if the table has one (``layers.read_counted``)."""
    if micros is not None:
        return calls.agg(F.max(micros).alias("us")).select(F.timestamp_micros("us").cast("timestamp_ntz").alias("newest_call"))
    return calls.agg(F.max("date_initiated").alias("newest_call"))


def staleness(newest: Column, now: Column) -> dict[str, Column]:
    """``call_known``, ``stale`` (older than STALE_DAYS) and ``days_old``."""
    days = seconds_between(newest, now) / DAY_SECONDS
    return {"call_known": newest.isNotNull(), "stale": F.coalesce(days > STALE_DAYS, F.lit(False)), "days_old": F.bround(days, 1)}


def next_update(due: Column, success: Column, now: Column, ready: Column) -> dict[str, Column]:
    """The due time as states: overdue strictly after the grace period without a success since it was due.

    Before the first load nothing is promised: nothing is known or overdue.
    """
    known = due.isNotNull() & ready
    late = due + F.expr(f"interval {GRACE_DAYS} days")
    overdue = F.coalesce(known & (now > late) & ~F.coalesce(success >= due, F.lit(False)), F.lit(False))
    seconds = seconds_between(late, now)
    return {
        "due_known": known, "due_passed": F.coalesce(known & (now > due), F.lit(False)), "overdue": overdue,
        "seconds_overdue": F.when(overdue, F.floor(seconds)), "days_overdue": F.when(overdue, F.bround(seconds / DAY_SECONDS, 1)),
    }


def lag_owner(behind: Column, overdue: Column) -> Column:
    """Whose limit a lag is: a layer behind is this system's; an overdue sync leaves it unknown; else the source's."""
    return F.when(behind, "this_system").when(overdue, "unknown").otherwise("source")


def freshness(layers: DataFrame, newest: DataFrame, now: str) -> DataFrame:
    """One row per store with all of the above. ``newest`` has (store, newest_call)."""
    at = F.lit(now).cast("timestamp_ntz")
    out = store_freshness(layers).join(readiness(layers), "store").join(newest, "store", "left")
    out = out.withColumns(staleness(F.col("newest_call"), at))
    out = out.withColumns(next_update(F.col("next_due_at"), F.col("last_success_at"), at, F.col("readiness") == "ready"))
    return out.withColumn("lag_owner", lag_owner(F.col("behind"), F.col("overdue")))


def source_intervals(history: DataFrame) -> DataFrame:
    """Distinct publishes of each layer with the seconds since the one before."""
    edits = history.filter("edited_at is not null").select("layer", "edited_at").distinct()
    w = Window.partitionBy("layer").orderBy("edited_at")
    return edits.withColumn("seconds", seconds_between(F.lag("edited_at").over(w), F.col("edited_at")))


def source_estimate(intervals: DataFrame, now: str) -> DataFrame:
    """Per layer: the last publish plus the median interval, if at least LEAST_INTERVALS were observed."""
    at = F.lit(now).cast("timestamp_ntz")
    by = intervals.groupBy("layer").agg(
        F.count("seconds").alias("intervals"), F.percentile("seconds", F.lit(0.5)).alias("median_s"), F.max("edited_at").alias("last")
    )
    known = F.col("intervals") >= LEAST_INTERVALS
    estimate = F.when(known, F.col("last") + F.make_dt_interval(secs=F.col("median_s").cast("decimal(18,6)")))
    out = by.select("layer", "intervals", known.alias("known"), estimate.alias("estimated_next"),
                    F.when(known, F.bround(F.col("median_s") / DAY_SECONDS, 1)).alias("median_days"))
    return out.withColumn("passed", F.coalesce(at > F.col("estimated_next"), F.lit(False)))
