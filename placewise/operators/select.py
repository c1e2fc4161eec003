"""Selection: attribute pivot, labels, the type dimension, usable calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Attribute names of the key-value store and the columns that they become.
ATTRIBUTES = {
    "Alleged Violation": "label",
    "Vehicle Was Towed": "tow_flag",
    "Property Ownership": "owner",
    "Vehicle Make": "make",
    "Vehicle Model": "model",
    "Vehicle Colour": "colour",
}
LABEL = "Alleged Violation"


def pivot_attributes(fields: DataFrame, attributes: dict[str, str] = ATTRIBUTES, label: str = LABEL) -> DataFrame:
    """One row per request that has a label: its attributes (of repeats, the largest value) and ``label_rows``."""
    return (
        fields.groupBy("request_id")
        .agg(
            *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in attributes.items()],
            F.count_if(F.col("name") == label).alias("label_rows"),
        )
        .filter("label_rows > 0")
    )


def ids_by_substring(fields: DataFrame, text: str, label: str = LABEL) -> DataFrame:
    """Distinct requests whose label contains the text in any case; % and _ in it are wildcards."""
    hit = (F.col("name") == label) & F.upper("value").like("%" + text.upper() + "%")
    return fields.filter(hit).select("request_id").distinct()


def matched_labels(fields: DataFrame, text: str, label: str = LABEL) -> DataFrame:
    """The labels that a substring matches, sorted."""
    hit = (F.col("name") == label) & F.upper("value").like("%" + text.upper() + "%")
    return fields.filter(hit).select(F.col("value").alias("raw_label")).distinct().orderBy("raw_label")


def ids_by_type(fields: DataFrame, dimension: DataFrame, canonical: str, label: str = LABEL) -> DataFrame:
    """Distinct requests with a label of one canonical type."""
    labels = labels_of(dimension, canonical)
    rows = fields.filter(F.col("name") == label)
    return rows.join(labels, rows["value"] == labels["raw_label"], "left_semi").select("request_id").distinct()


def labels_of(dimension: DataFrame, canonical: str) -> DataFrame:
    """The raw labels of one canonical type."""
    return dimension.filter((F.col("status") == "assigned") & (F.col("canonical_type") == canonical)).select("raw_label")


def canonical_types(fields: DataFrame, dimension: DataFrame, label: str = LABEL) -> DataFrame:
    """``(request_id, canonical_type)``, one type per request: of its labels that have one, that of the highest object id."""
    kinds = dimension.filter("status = 'assigned'").select(F.col("raw_label").alias("value"), "canonical_type")
    rows = fields.filter(F.col("name") == label).join(kinds, "value")
    return rows.groupBy("request_id").agg(F.max_by("canonical_type", "object_id").alias("canonical_type"))


def load(calls: DataFrame, fields: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Calls of a selection with their attributes (optional), wall clock, address and vehicle.

    Both tables are reduced to the ids before the pivot, so that only selected rows are shuffled for it.
    """
    if ids is not None:
        calls = calls.join(ids, "request_id", "left_semi")
        fields = fields.join(ids, "request_id", "left_semi")
    joined = calls.join(pivot_attributes(fields), "request_id", "left")
    return joined.select(
        "*",
        C.to_local(F.col("date_initiated")).alias("local"),
        C.clean_address(F.col("address")).alias("door"),
        C.vehicle_key(F.col("make"), F.col("model"), F.col("colour")).alias("vehicle"),
        C.tow_status(F.col("tow_flag")).alias("tow_status"),
    )


def usable(loaded: DataFrame) -> DataFrame:
    """Calls with a wall clock and an address."""
    return loaded.filter("local is not null and door is not null")


def missing_ids(ids: DataFrame, calls: DataFrame) -> DataFrame:
    """Selected ids without a call."""
    return ids.join(calls, "request_id", "left_anti")


def before_midnight_after(local: Column, day: str) -> Column:
    """Strictly before the local midnight that ends the day."""
    return local < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")


def located(calls: DataFrame) -> DataFrame:
    """Calls with an address and both coordinates, neither null nor zero."""
    door = C.clean_address(F.col("address"))
    return calls.withColumn("door", door).filter("door is not null and latitude <> 0 and longitude <> 0")


def residue_sample(df: DataFrame, modulus: int = 128, column: str = "request_id") -> DataFrame:
    """The same records in every version: those of one residue class."""
    return df.filter(F.col(column) % modulus == 0)


def upsert_by_key(df: DataFrame, key: str, order: str | Column, part: list[str] | None = None) -> DataFrame:
    """Of rows that repeat a key, the last written. ``part`` names columns that follow from the key: rows that are dealt by them stay so."""
    keys = [*(part or []), key]
    names = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("row"))
    return last.select(*keys, *[F.col(f"row.{c}").alias(c) for c in names]).select(*df.columns)


def coverage(fields: DataFrame, dimension: DataFrame, label: str = LABEL) -> DataFrame:
    """Live label rows by status of the dimension, with the share that has a type."""
    live = fields.filter(F.col("name") == label).groupBy(F.col("value").alias("raw_label")).agg(F.count("*").alias("n"))
    status = F.when(F.col("raw_label").isNull(), "null").otherwise(F.coalesce("status", F.lit("unknown")))
    by = live.join(dimension.select("raw_label", "status"), "raw_label", "left").withColumn("status", status)
    counts = {s: F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)) for s in ("null", "excluded", "ambiguous", "unknown", "assigned")}
    total = F.sum("n")
    return by.agg(
        total.alias("total"),
        *[c.alias(f"n_{s}") for s, c in counts.items()],
        F.bround(F.try_divide(counts["assigned"].cast("double"), total.cast("double")), 6).alias("assigned_share"),
    )


def dimension_faults(dimension: DataFrame) -> DataFrame:
    """Labels that stand in more than one row of the dimension; none in a sound one."""
    return dimension.groupBy("raw_label").agg(F.count("*").alias("uses")).filter("uses > 1")


#: A doorway of more calls than this, or than a hundred-thousandth of all, is cut into runs; so there are fewer than 100,000.
BUSY_CALLS, BUSY_DOORS = 1_000_000, 100_000


def busy_doors(calls: DataFrame, least: int = BUSY_CALLS) -> DataFrame:
    """``(door, calls)``: doorways with so many calls that one task should not hold them."""
    counts = calls.groupBy(C.clean_address(F.col("address")).alias("door")).agg(F.count("*").alias("calls"))
    total = counts.agg((F.sum("calls") / BUSY_DOORS).alias("share"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("door").isNotNull() & (F.col("calls") > F.greatest(F.lit(least), "share"))).drop("share")  # one row
