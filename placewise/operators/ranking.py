"""Numbers and medians of groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.layers import settled, settled_and_counted

#: A list of so many rows at most is sorted by one task.
SHORT_LIST = 100_000


def ordered(rows: DataFrame, by: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame, Column]:
    """The rows in order, written; a short row for each of their runs; and the condition that joins the two.

    The rows are dealt into ranges of (``by``, ``order``), and a run is what a range holds of a group, so no run is larger
    than a range, however large a group is. Rows have ``_at``, which grows in order; runs ``_first`` and ``_n``, the
    least ``_at`` and the number of their rows, and ``_before``, the number of the group's rows in earlier runs.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    rows = settled(rows.withColumns(dict(zip(keys, order, strict=True))), "unordered")  # so that finding the ranges works nothing out twice
    return _dealt(rows, by, keys)


def _dealt(rows: DataFrame, by: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    dealt = rows.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
    placed = settled(dealt.drop(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    runs = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by], F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_part")) - F.col("_n"))  # a row per range
    same = F.shiftright("_at", 33) == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed, runs, same


def numbered(rows: DataFrame, by: list[str], order: list[Column], short: int = SHORT_LIST) -> DataFrame:
    """The rows with ``rank``, their number within ``by`` in the order of ``order``, which must tell rows apart.

    The rows are written and counted. Up to ``short`` of them are sorted where they meet; of more, a run's rows are numbered
    on from those of the runs before (see ``ordered``), so no task sorts a longer list, whatever its keys are.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    rows, n = settled_and_counted(rows.withColumns(dict(zip(keys, order, strict=True))), "unordered")
    if n <= short:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).drop(*keys)
    placed, runs, same = _dealt(rows, by, keys)
    out = placed.join(runs, same).withColumn("rank", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int"))
    return out.drop("_at", "_part", "_first", "_n", "_before", *[f"_{c}" for c in by])


MEDIAN_CELL = 16.0


def median(counts: DataFrame, value: str, by: list[str], n: str, cell: float = MEDIAN_CELL) -> DataFrame:
    """The exact median per group of values that occur ``n`` times, halfway between the middle two of an even number; groups
    without values have no row (without ``by``, the one row is null).

    Counts are summed up by cells of the width ``cell``; only the different values in the cells of the middle ranks are sorted,
    so neither a large group nor a common value meets in one task.
    """
    at = counts.filter(F.col(value).isNotNull()).withColumn("_cell", F.floor(F.col(value) / cell))
    cells = at.groupBy(*by, "_cell").agg(F.sum(n).alias("_n"))
    upto = cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell")))  # a row per cell
    upto = upto.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # ranks of the middle, from 1
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    wanted = upto.filter(holds(low) | holds(high)).select(*by, "_cell", (F.col("_upto") - F.col("_n")).alias("_before"), low.alias("_low"), high.alias("_high"))
    middle = at.join(wanted, [*by, "_cell"])  # two cells a group at most
    last = F.col("_before") + F.sum(n).over(Window.partitionBy(*by, "_cell").orderBy(value))
    middle = middle.groupBy(*by, "_cell", "_before", "_low", "_high", value).agg(F.sum(n).alias(n)).withColumn("_last", last)
    has = lambda rank: (F.col("_last") >= F.col(rank)) & (F.col("_last") - F.col(n) < F.col(rank))
    ends = middle.select(*by, value, has("_low").alias("_is_low"), has("_high").alias("_is_high")).filter("_is_low or _is_high").groupBy(*by)
    found = ends.agg(F.max(F.when(F.col("_is_low"), F.col(value))).alias("_a"), F.max(F.when(F.col("_is_high"), F.col(value))).alias("_b"))
    return found.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(value))
