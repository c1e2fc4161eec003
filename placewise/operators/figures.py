"""Statistics on recurrence, with the type as a grouping key: one plan for all types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..sources.layers import settled
from .places import RECUR_DAYS, with_gaps
from .ranking import median
from .select import LABEL

#: The normal quantile of a 95 per cent interval; sample floors; shares of the vehicle verdict.
Z95 = 1.959963984540054
MIN_TOW_GROUP = 30
MIN_VEHICLES = 30
MOSTLY_DISTINCT = 0.90
SUBSTANTIAL_REPEAT = 0.70

SEED = 20260101
REPLICATES = 2000
#: Doorways that one array holds; replicates, and draws, that a task makes at once; cells that doorways are numbered by.
BLOCK_DOORS = 1024
REPLICATES_AT_ONCE = 100
DRAWS_AT_ONCE = 1 << 16
CELLS = 1024
STATUSES = ("towed", "not_towed", "unknown")


def recurrence_flags(loaded: DataFrame, recur_days: int = RECUR_DAYS, by: list[str] | None = None, busy: DataFrame | None = None) -> DataFrame:
    """Every usable call with ``recurs``, also at doorways that are not listed. ``busy``: see ``places.with_gaps``."""
    return with_gaps(loaded, recur_days, by or [], busy)


def recurrence_by_tow(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, recurring calls and their percentage for each tow status; statuses without calls have zeros."""
    spark, by = flags.sparkSession, by or []
    statuses = spark.createDataFrame([(s,) for s in STATUSES], "tow_status string")
    groups = flags.select(*by).distinct().crossJoin(F.broadcast(statuses)) if by else statuses  # three rows
    found = flags.groupBy(*by, "tow_status").agg(F.count("*").alias("calls"), F.count_if("recurs").alias("recurring"))
    out = groups.join(found, [*by, "tow_status"], "left").fillna(0, ["calls", "recurring"])
    return out.withColumn("pct", C.percent(F.col("recurring"), F.col("calls")))


def tallies(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per doorway: calls and recurring calls, towed and not towed."""
    one = lambda s, *more: F.count_if(F.expr(" and ".join([f"tow_status = '{s}'", *more])))
    return flags.groupBy(*(by or []), "door").agg(
        one("towed").alias("tn"), one("towed", "recurs").alias("tr"), one("not_towed").alias("nn"), one("not_towed", "recurs").alias("nr")
    )


def group_totals(doorway_tallies: DataFrame, by: list[str] | None = None) -> DataFrame:
    return doorway_tallies.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tn", "tr", "nn", "nr")])


def wald_interval(totals: DataFrame) -> DataFrame:
    """The textbook interval of the difference of two proportions, in percentage points; null for an empty group."""
    p1, p2 = F.try_divide(F.col("tr"), F.col("tn")), F.try_divide(F.col("nr"), F.col("nn"))
    se = F.sqrt(F.try_divide(p1 * (1 - p1), F.col("tn")) + F.try_divide(p2 * (1 - p2), F.col("nn")))
    return totals.withColumns(
        {"difference": 100 * (p1 - p2), "wald_lo": 100 * (p1 - p2 - Z95 * se), "wald_hi": 100 * (p1 - p2 + Z95 * se)}
    )


def numbered_doors(doorway_tallies: DataFrame, by: list[str]) -> DataFrame:
    """Doorways with ``idx``, their number from 0 in their group, and ``n``, the group's size.

    They are numbered within cells of a hash of their names, and cells by the counts before them.
    """
    cell = F.conv(F.substring(F.md5(F.col("door").cast("binary")), 1, 8), 16, 10).cast("long") % CELLS
    rows = doorway_tallies.withColumn("cell", cell)
    cells = rows.groupBy(*by, "cell").agg(F.count("*").alias("many"))
    before = F.sum("many").over(Window.partitionBy(*by).orderBy("cell")) - F.col("many")  # at most CELLS rows a group
    cells = cells.select(*by, "cell", before.alias("before"), F.sum("many").over(Window.partitionBy(*by)).alias("n"))
    within = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("door"))
    return rows.join(cells, [*by, "cell"]).withColumn("idx", F.col("before") + within - 1).drop("cell", "before")


def cluster_bootstrap(doorway_tallies: DataFrame, by: list[str] | None = None, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Percentile interval of the difference over resamples of whole doorways, as many draws as the group has doorways.

    A group's doorways lie in blocks of ``BLOCK_DOORS`` by number, an array each. A resample is drawn in two levels, which
    gives the same multinomial counts as drawing from all: each draw first falls on a doorway number and so in a block, and
    the draws of a block are counted; then as many doorways are drawn within it. A group of one block needs no first
    level. Draws are a hash of (seed, replicate, block, draw), so the result depends on no partitioning and any SQL engine
    gives the same; only counts a block and sums a replicate are shuffled. Replicates with an empty group are dropped; ends are
    taken by nearest rank, half to even. A group without doorways has no row.
    """
    by = by or []
    spark = doorway_tallies.sparkSession
    tasks = spark.sparkContext.defaultParallelism * 2
    tally = ("tn", "tr", "nn", "nr")
    rows = numbered_doors(doorway_tallies, by).withColumn("block", F.floor(F.col("idx") / BLOCK_DOORS))
    blocks = rows.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("idx", *tally))).alias("doors"), F.max("n").alias("n"))
    # Written, since a block's doorways go to the runs of its replicates and its group's size to the first level.
    blocks = settled(blocks.withColumn("doors", F.transform("doors", lambda d: F.struct(*[d[c].alias(c) for c in tally]))), "blocks")
    reps = lambda rows: rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(REPLICATES_AT_ONCE))))
    each = F.sequence(F.col("first"), F.least(F.col("first") + REPLICATES_AT_ONCE - 1, F.lit(replicates - 1)))
    small = reps(blocks.filter(F.col("n") <= BLOCK_DOORS)).withColumn("draws", F.transform(each, lambda r: F.struct(r.alias("rep"), F.size("doors").cast("long").alias("m"))))

    large = blocks.filter(F.col("n") > BLOCK_DOORS)
    groups = reps(large.filter("block = 0").select(*by, "n"))
    chunks = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS_AT_ONCE).cast("long"))))
    chunks = chunks.repartition(tasks, "first", "at", *by).withColumn("rep", F.explode(each))
    chunks = chunks.withColumn("stream", C.stream_of(seed, F.col("rep"), F.lit(0)))
    k = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + DRAWS_AT_ONCE, F.col("n")) - 1))
    fallen = chunks.select(*by, "first", "rep", "n", "stream", k.alias("k"))
    fallen = fallen.withColumn("block", F.floor(C.draw(F.col("stream"), F.col("k")) % F.col("n") / BLOCK_DOORS))
    counts = fallen.groupBy(*by, "block", "first", "rep").agg(F.count("*").alias("m"))
    counts = counts.groupBy(*by, "block", "first").agg(F.collect_list(F.struct("rep", "m")).alias("draws"))  # REPLICATES_AT_ONCE at most
    runs = small.select(*by, "block", "first", "doors", "draws").unionByName(large.join(counts, [*by, "block"]).select(*by, "block", "first", "doors", "draws"))

    runs = runs.repartition(tasks, "block", "first", *by).select(*by, "block", "doors", F.inline("draws"))
    runs = runs.withColumn("stream", C.stream_of(seed, F.col("rep"), F.col("block") + 1))
    draws = runs.select(*by, "rep", "doors", "stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    drawn = draws.select(*by, "rep", F.get("doors", (C.draw(F.col("stream"), F.col("k")) % F.size("doors")).cast("int")).alias("d")).select(*by, "rep", "d.*")
    sums = drawn.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in tally]).filter("tn > 0 and nn > 0")
    d = sums.groupBy(*by).agg(F.array_sort(F.collect_list(100 * (F.col("tr") / F.col("tn") - F.col("nr") / F.col("nn")))).alias("d"))
    at = lambda share: F.get("d", F.bround(share * (F.size("d") - 1), 0).cast("int"))
    return d.select(*by, F.size("d").alias("replicates"), at(F.lit(0.025)).alias("boot_lo"), at(F.lit(0.975)).alias("boot_hi"))


def effect_bound(doorway_tallies: DataFrame, by: list[str] | None = None, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Difference, both intervals and the reduction that each rules out; ``comparable`` is false for an empty group.

    The tallies, a row per doorway, are written first, since totals, sizes and resamples are all made of them.
    """
    by = by or []
    doorway_tallies = settled(doorway_tallies, "tallies")
    wald = wald_interval(group_totals(doorway_tallies, by))
    boot = cluster_bootstrap(doorway_tallies, by, replicates, seed)
    out = wald.join(boot, by, "left") if by else wald.join(boot, F.lit(True), "left")  # one row each
    ruled = lambda c: F.bround(F.greatest(F.lit(0.0), -F.col(c)), 1)
    return out.select(
        *by, "tn", "tr", "nn", "nr", ((F.col("tn") > 0) & (F.col("nn") > 0)).alias("comparable"),
        F.bround("difference", 2).alias("difference"),
        *[F.bround(c, 1).alias(c) for c in ("wald_lo", "wald_hi", "boot_lo", "boot_hi")],
        F.when(F.col("wald_lo").isNotNull(), ruled("wald_lo")).alias("wald_rules_out"),
        F.when(F.col("boot_lo").isNotNull(), ruled("boot_lo")).alias("boot_rules_out"),
    )


def tow_verdict(bound: DataFrame) -> DataFrame:
    """``tow_verdict`` from the rounded bootstrap interval."""
    small = (F.col("tn") < MIN_TOW_GROUP) | (F.col("nn") < MIN_TOW_GROUP)
    verdict = (
        F.when(small, "sample_too_small").when(F.col("boot_hi") < 0, "tow_lower").when(F.col("boot_lo") > 0, "tow_higher").otherwise("no_difference")
    )
    return bound.withColumn("tow_verdict", verdict)


def vehicle_totals(doors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Vehicles seen and distinct at listed doorways, and their number."""
    return doors.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("vehicles_seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("vehicles_distinct"), F.lit(0)).alias("distinct"),
        F.count("*").alias("doorways"),
    )


def vehicle_verdict(totals: DataFrame) -> DataFrame:
    """``share`` to three places and the verdict on it."""
    share = F.bround(F.try_divide(F.col("distinct").cast("double"), F.col("seen").cast("double")), 3)
    verdict = (
        F.when(F.col("seen") < MIN_VEHICLES, "sample_too_small").when(share >= MOSTLY_DISTINCT, "mostly_distinct")
        .when(share <= SUBSTANTIAL_REPEAT, "substantial_repeat").otherwise("mixed")
    )
    return totals.withColumn("share", share).withColumn("vehicle_verdict", verdict)


def type_record(measures: DataFrame, dimension: DataFrame, min_calls: int = 2, replicates: int = REPLICATES, key: str = "canonical_type") -> DataFrame:
    """One row per canonical type, those without calls too: totals, intervals, verdicts and a sentence of its own.

    ``measures`` are all doorways' (``places.door_measures``): their tallies by tow status, and the vehicles of listed ones.
    """
    types = dimension.filter("status = 'assigned'").select(key).distinct()
    measures = settled(measures.select(key, "door", "tn", "tr", "nn", "nr", "calls_12mo", "vehicles_seen", "vehicles_distinct"), "measures")
    tow = tow_verdict(effect_bound(measures.select(key, "door", "tn", "tr", "nn", "nr"), [key], replicates))
    listed = measures.filter((F.col("calls_12mo") > 0) & (F.col("calls_12mo") >= min_calls))
    out = types.join(tow, key, "left").join(vehicle_verdict(vehicle_totals(listed, [key])), key, "left")
    out = out.fillna(0, ["tn", "tr", "nn", "nr", "seen", "distinct", "doorways"]).fillna("sample_too_small", ["tow_verdict", "vehicle_verdict"])
    out = out.withColumn("comparable", F.coalesce("comparable", F.lit(False)))
    return out.withColumn("conclusion", F.concat_ws("; ", F.col(key), F.concat(F.lit("tows: "), "tow_verdict"), F.concat(F.lit("vehicles: "), "vehicle_verdict")))


def response_time(calls: DataFrame, as_of: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Median minutes from report to closure, closed calls and calls never closed.

    Calls are counted by their minutes, with map-side combine, and the counts are written; all figures come from them.
    """
    by = by or []
    minutes = C.elapsed_minutes(F.col("date_initiated"), F.col("date_closed")).alias("minutes")
    counts = _as_of(calls, as_of).groupBy(*by, minutes, F.col("date_closed").isNull().alias("open")).agg(F.count("*").alias("n"))
    counts = settled(counts, "minutes")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    totals = counts.groupBy(*by).agg(total(F.col("minutes").isNotNull())("closed"), total(F.col("open"))("never_closed"))  # no minutes unless both times are there
    middle = median(counts, "minutes", by, "n").withColumnRenamed("minutes", "median_minutes")
    out = totals.join(middle, by, "left") if by else totals.join(middle, F.lit(True), "left")  # a row per group
    return out.select(*by, "median_minutes", "closed", "never_closed")


def _as_of(loaded: DataFrame, as_of: str | None) -> DataFrame:
    from .select import before_midnight_after

    return loaded if as_of is None else loaded.filter(before_midnight_after(F.col("local"), as_of))


def label_counts(fields: DataFrame, ids: DataFrame, label: str = LABEL) -> DataFrame:
    """Distinct requests by label, over all labels that the selected requests carry, most common first."""
    rows = fields.filter(F.col("name") == label).join(ids, "request_id", "left_semi")
    return rows.groupBy(F.col("value").alias("label")).agg(F.count_distinct("request_id").alias("requests")).orderBy(F.desc("requests"), "label")


def denominators(loaded: DataFrame, fields: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """``(name, count)``: calls per label, of the selection, up to a day, towed, of known outcome, excluded."""
    usable = F.col("local").isNotNull() & F.col("door").isNotNull()
    known = F.col("tow_status") != "unknown"
    dated = F.coalesce(F.col("local") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz"), F.lit(False))
    one = loaded.agg(
        F.count("*").alias("selection"), F.count_if(dated).alias("as_of"),
        F.count_if(usable & (F.col("tow_status") == "towed")).alias("tow_cohort"),
        F.count_if(usable & known).alias("known_status"), F.count_if(usable & ~known).alias("excluded"),
    )
    rows = one.unpivot([], ["selection", "as_of", "tow_cohort", "known_status", "excluded"], "name", "count")
    return rows.unionByName(label_counts(fields, ids).select(F.concat(F.lit("label:"), "label").alias("name"), F.col("requests").alias("count")))


def denominators_by(loaded: DataFrame, fields: DataFrame, by: str, as_of: str | None = None) -> DataFrame:
    """A row per group: calls of the selection, up to a day, towed, of known outcome, excluded, and ``labels``, the distinct
    requests of every label that its calls carry, most common first."""
    usable, known = F.col("local").isNotNull() & F.col("door").isNotNull(), F.col("tow_status") != "unknown"
    dated = F.col("local").isNotNull() if as_of is None else F.coalesce(F.col("local") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz"), F.lit(False))
    out = loaded.groupBy(by).agg(
        F.count("*").alias("selection"), F.count_if(dated).alias("as_of"), F.count_if(usable & (F.col("tow_status") == "towed")).alias("tow_cohort"),
        F.count_if(usable & known).alias("known_status"), F.count_if(usable & ~known).alias("excluded"),
    )
    rows = fields.filter(F.col("name") == LABEL).join(loaded.select("request_id", by), "request_id")
    counts = rows.groupBy(by, F.col("value").alias("label")).agg(F.count_distinct("request_id").alias("requests"))
    listed = F.array_sort(F.collect_list(F.struct(F.negative("requests").alias("n"), "label")))  # a row per label
    labels = counts.groupBy(by).agg(F.transform(listed, lambda x: F.struct(x["label"].alias("label"), F.negative(x["n"]).alias("requests"))).alias("labels"))
    return out.join(labels, by, "left")
