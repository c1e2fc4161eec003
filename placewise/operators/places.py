"""The ranked doorway watchlist and its rollup to census blocks, for one selection or many types at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..sources.layers import settled
from .geo import locate
from .ranking import median, numbered, ordered
from .select import usable

#: Days before the newest call in which a doorway must have called; days in which a call recurs; calls and
#: doorways that lists begin with.
RECENCY_DAYS = 365
RECUR_DAYS = 365
MIN_CALLS = 2
MIN_DOORWAYS = 2


def with_gaps(loaded: DataFrame, recur_days: int, by: list[str], busy: DataFrame | None = None) -> DataFrame:
    """Usable calls with ``seq`` in their doorway, ``gap_days`` to its next call and ``recurs`` (within ``recur_days``).

    On calls in order the next one decides whether any later one is near enough. Gaps are whole days, floored. The calls
    of a doorway meet in one task, but for doorways in ``busy`` (``select.busy_doors``): theirs are cut into runs by time.
    """
    calls = usable(loaded)
    w = Window.partitionBy(*by, "door").orderBy("local", "request_id")
    plain = calls if busy is None else calls.join(F.broadcast(busy.select("door")), "door", "left_anti")
    out = plain.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("_next", F.lead("local").over(w))
    if busy is not None:
        out = out.unionByName(_in_runs(calls.join(F.broadcast(busy.select("door")), "door", "left_semi"), by))
    return _gaps(out, recur_days)


def _gaps(calls: DataFrame, recur_days: int) -> DataFrame:
    gap = F.timestamp_diff("DAY", F.col("local"), F.col("_next"))
    return calls.withColumn("gap_days", gap).withColumn("recurs", F.coalesce(F.col("gap_days") <= recur_days, F.lit(False))).drop("_next")


def _in_runs(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls with ``seq`` and ``_next``, the time of the doorway's next call. The last call of a run finds it in the run after."""
    keys = [*by, "door"]
    placed, runs, same = ordered(calls, keys, [F.col("local"), F.col("request_id")])
    begins = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in keys], F.shiftright("_at", 33).alias("_part")).agg(F.min("local").alias("_begins"))
    joined = F.lit(True)
    for c in [*[f"_{k}" for k in keys], "_part"]:
        joined = joined & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    runs = runs.alias("a").join(begins.alias("b"), joined).select("a.*", "b._begins")
    runs = runs.withColumn("_after", F.lead("_begins").over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_part")))  # a row per run
    within = Window.partitionBy(*keys, "_part").orderBy("_at")
    out = placed.join(runs, same).withColumn("seq", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    out = out.withColumn("_next", F.coalesce(F.lead("local").over(within), F.col("_after")))
    return out.select(*calls.columns, "seq", "_next")


def doorways(
    loaded: DataFrame,
    covered: DataFrame | None = None,
    min_calls: int = MIN_CALLS,
    recur_days: int = RECUR_DAYS,
    recency_days: int = RECENCY_DAYS,
    by: list[str] | None = None,
    district: str | None = None,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Ranked doorways that still call: at least ``min_calls`` in the window before the newest call.

    The newest call is that of the selection (``by`` group), with or without an address. With ``covered`` (``geo.cover``
    with the areas' dwellings), each doorway's median point is placed in its block. ``by`` names grouping columns of several
    selections at once. ``rank`` orders by score, ties by the doorway's lowest request id. ``busy``: see ``with_gaps``.
    """
    by = by or []
    measures = door_measures(loaded, recur_days, recency_days, by, busy)
    listed = measures.filter((F.col("calls_12mo") > 0) & (F.col("calls_12mo") >= min_calls))
    if district is not None and district.strip():
        listed = listed.filter(F.col("district") == district)
    return ranked(listed, covered, by)


#: What of a call is said of its doorway.
MEASURED = ("request_id", "door", "local", "district", "community", "owner", "vehicle", "tow_flag", "tow_status", "latitude", "longitude")


def door_measures(
    loaded: DataFrame, recur_days: int = RECUR_DAYS, recency_days: int = RECENCY_DAYS, by: list[str] | None = None, busy: DataFrame | None = None
) -> DataFrame:
    """One row per doorway, listed or not, with all that a list says of it and its tallies by tow status.

    Calls are shuffled once, by doorway; every window and sum after that stays in the doorway's partition. Those of
    ``busy`` doorways are cut into runs and summed up in parts.
    """
    by = by or []
    loaded = loaded.select(*by, *[c for c in MEASURED if c not in by])  # runs are written, so no other column may come along
    latest = loaded.groupBy(*by).agg(F.max("local").alias("latest"))
    if busy is not None:
        latest = settled(latest, "latest")
    # one row per selection: a join on its key, or on nothing
    with_latest = lambda calls: calls.join(F.broadcast(latest), by) if by else calls.crossJoin(F.broadcast(latest))
    if busy is None:
        return _measures(with_latest(with_gaps(loaded, recur_days, by)), recency_days, by)
    doors = F.broadcast(busy.select("door"))
    out = _measures(with_latest(with_gaps(loaded.join(doors, "door", "left_anti"), recur_days, by)), recency_days, by)
    runs = _in_runs(usable(loaded).join(doors, "door", "left_semi"), by)
    calls = settled(with_latest(_gaps(runs, recur_days)), "busy")
    return out.unionByName(_measures_in_parts(calls, recency_days, by))


def _sums(recency_days: int) -> list[Column]:
    """What is said of a doorway by sums and extremes alone."""
    recent = F.col("local") >= F.col("latest") - F.expr(f"interval {recency_days} days")
    tally = lambda s, *more: F.count_if(F.expr(" and ".join([f"tow_status = '{s}'", *more])))
    return [
        F.count_if(recent).alias("calls_12mo"),
        F.count("*").alias("calls_total"),
        F.max_by("district", "seq").alias("district"),
        F.max_by("community", "seq").alias("community"),
        F.count_if(F.col("tow_flag") == "Y").alias("tows"),
        F.count("vehicle").alias("vehicles_seen"),
        F.count_if("recurs").alias("repeat_calls"),
        F.date_format(F.max("local"), "yyyy-MM-dd").alias("last_call"),
        F.min("request_id").alias("first_seen"),
        tally("towed").alias("tn"), tally("towed", "recurs").alias("tr"), tally("not_towed").alias("nn"), tally("not_towed", "recurs").alias("nr"),
    ]


def _measures(calls: DataFrame, recency_days: int, by: list[str]) -> DataFrame:
    keys = [*by, "door"]
    # The most frequent owner, null counting as a value, ties to the one seen first; a vehicle counts at its first call.
    owners, vehicles = Window.partitionBy(*keys, "owner"), Window.partitionBy(*keys, "vehicle").orderBy("seq")
    calls = calls.withColumn("often", F.struct(F.count("*").over(owners).alias("n"), F.negative(F.min("seq").over(owners)).alias("first")))
    calls = calls.withColumn("new_vehicle", F.col("vehicle").isNotNull() & (F.row_number().over(vehicles) == 1))
    return calls.groupBy(*keys).agg(
        *_sums(recency_days),
        F.max_by("owner", "often").alias("owner"),
        F.count_if("new_vehicle").alias("vehicles_distinct"),
        F.percentile("gap_days", F.lit(0.5)).alias("median_gap_days"),
        F.percentile(F.nullif("latitude", F.lit(0.0)), F.lit(0.5)).alias("lat"),
        F.percentile(F.nullif("longitude", F.lit(0.0)), F.lit(0.5)).alias("lon"),
    )


#: Widths of the cells in which medians of gaps, in days, and of coordinates, in degrees, are looked for.
GAP_CELL, DEGREE_CELL = 16.0, 1.0 / 4096


def _measures_in_parts(calls: DataFrame, recency_days: int, by: list[str]) -> DataFrame:
    """As ``_measures``, by aggregates that are combined before each shuffle, so that a doorway's calls never meet."""
    keys = [*by, "door"]
    owners = calls.groupBy(*keys, "owner").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    owners = owners.groupBy(*keys).agg(F.max_by("owner", F.struct("n", F.negative("first"))).alias("owner"))
    vehicles = calls.filter("vehicle is not null").groupBy(*keys, "vehicle").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("vehicles_distinct"))
    out = calls.groupBy(*keys).agg(*_sums(recency_days))
    parts = [owners, vehicles]
    for value, name, cell in (("gap_days", "median_gap_days", GAP_CELL), ("latitude", "lat", DEGREE_CELL), ("longitude", "lon", DEGREE_CELL)):
        kept = F.col(value).cast("double") if value == "gap_days" else F.nullif(value, F.lit(0.0))
        parts.append(median(calls.groupBy(*keys, kept.alias(name)).agg(F.count("*").alias("n")), name, keys, "n", cell))
    for part in parts:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))
        added = [c for c in part.columns if c not in keys]
        out = out.alias("_a").join(part.alias("_b"), same, "left").select("_a.*", *[f"_b.{c}" for c in added])
    return out.fillna(0, ["vehicles_distinct"])


def ranked(listed: DataFrame, covered: DataFrame | None, by: list[str]) -> DataFrame:
    """Listed doorways with street, tow rate, block and rank."""
    listed = listed.withColumn("tow_rate", F.col("tows") / F.col("calls_total"))
    listed = listed.withColumn("street", C.street_of(F.col("door")))
    if covered is not None:
        listed = locate(settled(listed, "listed"), covered, carry=["dwellings"])  # its points are looked up apart
    else:
        listed = listed.withColumn("block", F.lit(None).cast("string")).withColumn("block_dwellings", F.lit(None).cast("int"))
    listed = listed.drop("tn", "tr", "nn", "nr").withColumnRenamed("door", "address")
    return numbered(listed, by, [F.negative(C.score(F.col("calls_12mo"), F.col("tow_rate"))), F.col("first_seen")])


def blocks(doors: DataFrame, min_doorways: int = MIN_DOORWAYS, by: list[str] | None = None) -> DataFrame:
    """Ranked blocks of listed doorways: those with at least ``min_doorways``. Doorways are shuffled once, by block."""
    by = by or []
    keys = [*by, "block"]
    placed = doors.filter("block is not null and block <> ''")
    streets, districts = Window.partitionBy(*keys, "street"), Window.partitionBy(*keys, "district")
    placed = placed.withColumn("at", F.struct(F.negative(F.sum("calls_12mo").over(streets)).alias("n"), F.min("rank").over(streets).alias("r"), "street"))
    placed = placed.withColumn("often", F.struct(F.count("*").over(districts).alias("n"), F.negative(F.min("rank").over(districts)).alias("first")))
    # A block holds few doorways and fewer streets, which its row lists anyway.
    top = F.slice(F.array_sort(F.collect_set(F.when(F.col("street").isNotNull(), F.col("at")))), 1, 2)
    out = placed.groupBy(*keys).agg(
        F.count("*").alias("doorways"),
        F.sum("calls_12mo").alias("calls_12mo"),
        F.sum("calls_total").alias("calls_total"),
        F.sum("tows").alias("tows"),
        F.coalesce(F.max("block_dwellings"), F.lit(0)).alias("dwellings"),
        F.max_by("address", F.struct("calls_12mo", F.negative("rank"))).alias("worst_doorway"),
        F.max_by("district", "often").alias("district"),
        F.array_join(F.transform(top, lambda s: s["street"]), " / ").alias("streets"),
        F.array_join(F.array_sort(F.collect_list("address")), "; ").alias("addresses"),
        F.min("rank").alias("first_rank"),
    )
    out = out.withColumn("calls_per_1k_dwellings", C.per_thousand(F.col("calls_12mo"), F.col("dwellings")))
    out = out.filter(F.col("doorways") >= min_doorways)
    order = [F.negative("doorways"), F.negative(F.coalesce("calls_per_1k_dwellings", F.lit(0.0))), F.col("first_rank")]
    return numbered(out, by, order).drop("first_rank")


def neighbours(doors: DataFrame, min_doorways: int = MIN_DOORWAYS, by: list[str] | None = None) -> DataFrame:
    """As ``with_neighbours``, from the doorways alone: those of one block are counted where they meet."""
    own = F.coalesce(F.nullif("block", F.lit("")), F.concat(F.lit("\u0000"), "address"))  # a doorway without a block is alone
    n = F.count("*").over(Window.partitionBy(*(by or []), own))
    return doors.withColumn("block_doorways_calling", F.when(n >= min_doorways, n).otherwise(F.lit(1)))


def with_neighbours(doors: DataFrame, block_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Doorways with ``block_doorways_calling``: the doorways of their listed block, else 1."""
    keys = [*(by or []), "block"]
    n = block_rows.select(*keys, F.col("doorways").alias("block_doorways_calling"))
    return doors.join(n, keys, "left").fillna(1, ["block_doorways_calling"])


def headline(loaded: DataFrame, doors: DataFrame) -> DataFrame:
    """One row: calls, tows and their share, share without outcome, doorways, vehicles and the unique share."""
    a = loaded.agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("tow_flag") == "Y").alias("tows"),
        C.percent(F.count_if(F.col("tow_flag") == "Y"), F.count("*")).alias("tow_pct"),
        C.percent(F.count_if(F.coalesce(F.col("tow_status"), F.lit("unknown")) == "unknown"), F.count("*")).alias("no_outcome_pct"),
    )
    b = doors.agg(
        F.count("*").alias("addresses"),
        F.coalesce(F.sum("vehicles_seen"), F.lit(0)).alias("seen"),
        F.coalesce(F.sum("vehicles_distinct"), F.lit(0)).alias("distinct"),
        C.percent(F.sum("vehicles_distinct"), F.sum("vehicles_seen"), 0).alias("unique_pct"),
    )
    return a.crossJoin(F.broadcast(b))  # one row each


def page_summary(loaded: DataFrame, doors: DataFrame) -> DataFrame:
    """One row: tow and unique percentages, distinct and seen vehicles, doorways with a calling neighbour."""
    a = loaded.agg(C.percent(F.count_if(F.col("tow_flag") == "Y"), F.count("*")).alias("tow_pct"))
    b = doors.agg(
        C.percent(F.sum("vehicles_distinct"), F.sum("vehicles_seen"), 0).alias("unique_pct"),
        F.coalesce(F.sum("vehicles_distinct"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("vehicles_seen"), F.lit(0)).alias("seen"),
        F.count_if(F.col("block_doorways_calling") >= 2).alias("with_neighbour"),
    )
    return a.crossJoin(F.broadcast(b))  # one row each


def block_headline(block_rows: DataFrame, doors: DataFrame) -> DataFrame:
    """One row: blocks listed, the doorways that they hold, doorways listed, doorways without a block."""
    a = block_rows.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("doorways"), F.lit(0)).alias("doorways_held"))
    b = doors.agg(F.count("*").alias("doorways_listed"), F.count_if(F.col("block").isNull()).alias("unplaced"))
    return a.crossJoin(F.broadcast(b))


def display_doorways(doors: DataFrame) -> DataFrame:
    """Doorways as a page shows them: short names, title case, '?' for no district."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return doors.select(
        (F.col("rank") - 1).alias("i"), C.title_case(F.col("address")).alias("a"), F.coalesce("district", F.lit("?")).alias("d"),
        C.title_case(text("community")).alias("c"), C.title_case(text("street")).alias("st"), text("block").alias("bk"),
        F.col("block_doorways_calling").alias("nb"), F.col("calls_12mo").alias("m"), F.col("calls_total").alias("t"),
        F.col("tows").alias("w"), F.col("vehicles_distinct").alias("vd"), F.col("vehicles_seen").alias("vs"),
        F.col("repeat_calls").alias("rp"), F.bround("median_gap_days", 0).cast("long").alias("g"), F.col("last_call").alias("l"),
        text("owner").alias("o"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"),
    )


def display_blocks(block_rows: DataFrame) -> DataFrame:
    """Blocks as a page shows them; addresses are an array again."""
    addresses = F.filter(F.transform(F.split("addresses", ";"), lambda a: C.strip(a)), lambda a: a != "")
    return block_rows.select(
        (F.col("rank") - 1).alias("i"), F.col("block").alias("bk"), C.title_case(F.col("streets")).alias("s"),
        F.col("doorways").alias("n"), F.col("calls_12mo").alias("m"), F.col("calls_total").alias("t"), F.col("tows").alias("w"),
        F.col("dwellings").alias("dw"), F.col("calls_per_1k_dwellings").alias("r"), F.coalesce("district", F.lit("?")).alias("d"),
        C.title_case(F.col("worst_doorway")).alias("worst"), F.transform(addresses, C.title_case).alias("addrs"),
    )


def stamp(rows: DataFrame, clocks: DataFrame) -> DataFrame:
    """Rows with the three clocks of a run as text, 'unknown' where null. ``clocks`` has one row."""
    names = ("derived_at", "last_sync", "latest_call")
    said = [F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("unknown")).alias(c) for c in names]
    return rows.crossJoin(F.broadcast(clocks.select(*said)))


# Readable headers of the exported lists, in their order, over the columns that pages show.
DOORWAY_HEADERS = {
    "a": "Address", "d": "District", "c": "Community", "st": "Street", "bk": "Block", "nb": "Doorways Calling On Block",
    "m": "Calls (12mo)", "t": "Calls (Total)", "rp": "Repeat Calls", "w": "Tows", "vd": "Vehicles Distinct", "vs": "Vehicles Seen",
    "g": "Median Gap Days", "l": "Last Call", "o": "Owner", "lat": "Latitude", "lon": "Longitude",
}
BLOCK_HEADERS = {
    "bk": "Block", "s": "Streets", "n": "Doorways", "m": "Calls (12mo)", "t": "Calls (Total)", "w": "Tows", "dw": "Dwellings",
    "r": "Calls per 1,000 Dwellings", "d": "District", "worst": "Worst Doorway", "addrs": "Addresses",
}
KIND_HEADER = "Violation Type"


def export_doorways(doors: DataFrame, kind: str) -> DataFrame:
    """Doorways as pages show them, under readable headers; the violation type comes last, on every row."""
    shown = display_doorways(doors)
    return shown.select(*[F.col(c).alias(h) for c, h in DOORWAY_HEADERS.items()], F.lit(kind).alias(KIND_HEADER))


def export_blocks(block_rows: DataFrame, kind: str) -> DataFrame:
    """Blocks as pages show them, under readable headers, addresses joined; the violation type comes last, on every row."""
    shown = display_blocks(block_rows).withColumn("addrs", F.array_join("addrs", "; "))
    return shown.select(*[F.col(c).alias(h) for c, h in BLOCK_HEADERS.items()], F.lit(kind).alias(KIND_HEADER))


def export_preamble(doors: DataFrame, block_rows: DataFrame, latest: DataFrame, kind: str, filters: dict[str, object]) -> DataFrame:
    """``(key, value)``: what an export says before its tables: type, slug, counts, newest call day and the filters in effect.

    ``latest`` is one row of ``latest``.
    """
    active = ", ".join(f"{k} = {v}" for k, v in sorted(filters.items()) if v is not None)
    one = (
        doors.agg(F.count("*").cast("string").alias("doorway_count"))
        .crossJoin(F.broadcast(block_rows.agg(F.count("*").cast("string").alias("block_count"))))  # one row each
        .crossJoin(F.broadcast(latest.select(F.date_format("latest", "yyyy-MM-dd").alias("latest_call_date"))))
    )
    said = {"violation_type": F.lit(kind), "slug": C.slug(F.lit(kind)), **{c: F.col(c) for c in one.columns}}
    said |= {f"filter: {k}": F.lit(None if v is None else str(v)).cast("string") for k, v in filters.items()}
    said["filters_in_effect"] = F.lit(active or "none")
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in said.items()])))
