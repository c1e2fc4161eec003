"""The dimension of violation types: which published labels make up a type, and how often each was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types, their published labels, and the rows that each label had when the table was drawn up.
# fmt: off
TYPES = {
    "No Parking Sign": [("No Parking Sign", 27404), ("NOPARKING", 265)],
    "Private Property": [("Private Property", 17061), ("PRIVATE", 72), ("On Private Property", 62)],
    "On Highway Over 24 Hours": [("On Highway Over 24 Hours", 12244), ("ONHIGHWAY", 44)],
    "Blocking Driveway": [("Blocking Driveway (DISPATCH)", 9770), ("DRIVEWAY", 64)],
    "Over Time Specified": [("Over Time Specified", 4902), ("OVERTIMESPEC", 44)],
    "Within 5M of Hydrant": [("Within 5M of Hydrant (DISPATCH)", 2383), ("Within 5M of Hydrant", 2030), ("HYDRANT", 32)],
    "Obstructing Snow Removal": [("Obstructing Snow Removal", 2579), ("Obstructing Snow Removal (DISPATCH)", 1236), ("SNOW", 91)],
    "Within 7.5M of Corner": [("Within 7.5M of Corner (DISPATCH)", 2417), ("Within 7.5M of Corner", 1403), ("CORNER", 31)],
    "No Stopping Sign": [("No Stopping Sign", 2780), ("NOSTOPPING", 30)],
    "Accessible Spot on Public Property": [("Accessible Spot on Public Property (DISPATCH)", 1403), ("Accessible Spot on Public Property", 1385), ("ACCESSPUB", 20)],
    "Within 10M of Stop Sign": [("Within 10M of Stop Sign (DISPATCH)", 1819), ("Within 10M of Stop Sign", 881), ("STOPSIGN", 19)],
    "On Sidewalk": [("On Sidewalk (DISPATCH)", 1080), ("On Sidewalk", 874), ("SIDEWALK", 21)],
    "Too Far From Curb": [("Too Far From Curb", 1626), ("CURB", 20)],
    "Under 3M For Traffic": [("Under 3M For Traffic", 1218), ("UNDER3M", 2)],
    "On Wrong Side": [("On Wrong Side", 1196), ("WRONGSIDE", 10)],
    "On or Within 5M of Crosswalk": [("On or Within 5M of Crosswalk", 527), ("On or Within 5M of Crosswalk (DISPATCH)", 499), ("CROSSWALK", 42)],
    "In Loading Zone": [("In Loading Zone", 958), ("LOADING", 8)],
    "In Fire Lane on Private Property": [("In Fire Lane on Private Property", 572), ("FIREPRIVATE", 14)],
    "In Bus Stop": [("In Bus Stop", 426), ("BUSSTOP", 6)],
    "Accessible Spot on Private Property": [("Accessible Spot on Private Property", 383), ("ACCESSPRIV", 12)],
    "Violating Winter Parking Ban": [("Violating Winter Parking Ban", 260), ("WINTERBAN", 28)],
    "In Fire Lane on Public Property": [("In Fire Lane on Public Property", 117), ("In Fire Lane on Public Property (DISPATCH)", 107), ("FIREPUBLIC", 3)],
    "Double Parked": [("Double Parked", 215), ("DOUBLE", 7)],
    "On Left Hand Side": [("On Left Hand Side", 170), ("LEFTHAND", 9)],
    "Obstructing Street Cleaning": [("Obstructing Street Cleaning", 125), ("STREETCLEANING", 4)],
    "Over Time at Meter": [("Over Time at Meter", 91)],
    "Parking in Bike Lane": [("Parking in Bike Lane", 88), ("BIKELANE", 3)],
    "Meter Violation": [("Meter Violation", 52)],
    "For Sale on Highway": [("For Sale on Highway", 13)],
    "Meter Feeding": [("Meter Feeding", 5)],
}
#: Labels that are no parking type.
EXCLUDED = {
    "Other": [("Other", 7474), ("OTHER", 68)],
    "Left Running": [("Left Running", 23), ("LEFTRUNNING", 2)],
}
#: Labels that could belong to more than one type.
AMBIGUOUS = [("OVERTIME", 1), ("VIOLATION", 4)]
LABELS, LABELLED_ROWS, NULL_ROWS = 71, 110834, 66
# fmt: on

REASONS = {"Other": "a catch-all without a meaning of its own", "Left Running": "idling, which another bylaw regulates"}
DIMENSION = "raw_label string, canonical_type string, status string, frozen_count long"


def dimension_rows() -> list[tuple[str, str | None, str, int]]:
    """``(raw_label, canonical_type, status, frozen_count)``; excluded and ambiguous labels have no type."""
    rows: list[tuple[str, str | None, str, int]] = [(label, kind, "assigned", n) for kind, labels in TYPES.items() for label, n in labels]
    rows += [(label, None, "excluded", n) for labels in EXCLUDED.values() for label, n in labels]
    return rows + [(label, None, "ambiguous", n) for label, n in AMBIGUOUS]


def type_dimension(spark: SparkSession) -> DataFrame:
    """The published labels as a dimension of 71 rows."""
    return spark.createDataFrame(dimension_rows(), DIMENSION)


def type_of(labelled: DataFrame, dimension: DataFrame, label: str = "label") -> DataFrame:
    """The input with ``canonical_type`` and ``label_status``: exact, case-sensitive lookup of ``label``.

    The type is null for excluded, ambiguous, unknown and null labels, whose status says which.
    """
    names = dimension.select(F.col("raw_label").alias(label), "canonical_type", F.col("status").alias("label_status"))
    out = labelled.join(F.broadcast(names), label, "left")  # a row per published label
    status = F.when(F.col(label).isNull(), "null").otherwise(F.coalesce("label_status", F.lit("unknown")))
    return out.withColumn("label_status", status)


def type_counts(dimension: DataFrame) -> DataFrame:
    """``(canonical_type, raw_label, count)`` of the labels that have a type."""
    return dimension.filter("status = 'assigned'").select("canonical_type", "raw_label", F.col("frozen_count").alias("count"))


def dimension_totals(dimension: DataFrame, labels: int = LABELS, rows: int | None = LABELLED_ROWS) -> DataFrame:
    """One row: labels and rows by status, the share with a type of those not excluded, and ``sound``: no label stands in
    two rows, and numbers of labels and rows are those stated (rows are not compared where None)."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("frozen_count"))), F.lit(0))
    assigned, excluded, every = of("assigned"), of("excluded"), F.coalesce(F.sum("frozen_count"), F.lit(0))
    out = dimension.agg(
        F.count("*").alias("entries"), F.count_distinct("raw_label").alias("labels"), F.count_distinct("canonical_type").alias("types"),
        every.alias("labelled_rows"), assigned.alias("assigned_rows"), excluded.alias("excluded_rows"), of("ambiguous").alias("ambiguous_rows"),
        F.bround(F.try_divide(assigned.cast("double"), (every - excluded).cast("double")), 6).alias("assigned_share"),
    )
    sound = (F.col("entries") == F.col("labels")) & (F.col("labels") == labels)
    if rows is not None:
        sound = sound & (F.col("labelled_rows") == rows)
    return out.withColumn("sound", sound)
