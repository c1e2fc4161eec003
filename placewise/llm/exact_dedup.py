"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Every text starts in one group. A round takes the next bytes of each text as its digit and splits each
group by digit. A text leaves when its group has one member (it is unique) or when its bytes have ended
(its group holds equal texts). Digits are compared as bytes, so equality needs no digest.

The digit widens from round to round, so a text of n bytes takes O(log n) rounds; a group is known by a
number given to it when its count is written, so a key never holds more than one digit.

Each round counts with map-side combine, so a group of any size arrives at a reducer as a few partial
counts, and relabels rows by a join in which rows of very frequent digits stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT_KEYS, Scratch, join_keyed

FIRST_WIDTH = 64
GROWTH = 16
MAX_WIDTH = 1 << 20
#: Digits of very frequent keys are broadcast, so many bytes of them at most.
HOT_BYTES = 1 << 26


RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **widths: int
) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``carry`` names further input columns to return (the text itself among them, if wanted); a result
    column hides an input column of its name. A null text counts as empty. The largest id of a group
    stays; null ids never win against an id, and in a group of null ids alone ``keep_id`` is null.
    ``kept`` holds for each row that has the group's ``keep_id``, so rows that repeat both id and text
    are all marked kept. An empty table gives no rows. ``widths``: see ``_partition``.
    """
    carry = [c for c in (carry or []) if c not in (id_col, *RESULT)]
    return _partition(docs, id_col, text_col, carry, **widths).select(
        F.col("_id").alias(id_col),
        *[F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns; of rows that repeat id and text, one.

    Null and empty texts are equal. A null id stays only where no row of its group has one. Very long texts are compared
    digit by digit. An empty table gives no rows.
    """
    stay = _partition(docs, id_col, text_col, docs.columns).filter(F.col("_id").eqNullSafe(F.col("_keep")))
    one = stay.filter("_n = 1").unionByName(stay.filter("_n > 1").dropDuplicates(["_id", "_class"]))
    return one.select(*[F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _partition(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    carry: list[str],
    first_width: int = FIRST_WIDTH,
    growth: int = GROWTH,
) -> DataFrame:
    """Rows with ``_id``, ``_carry``, ``_sha`` and, of their final group, ``_n``, ``_keep`` and its number ``_class``."""
    scratch = Scratch(docs.sparkSession, "exact")
    carried = carry.index(text_col) if text_col in carry else None
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].alias("_id"),
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("_")).alias("_carry"),
        F.sha2(text, 256).alias("_sha"),
        F.lit(0).cast("long").alias("_group"),
        (text if carried is None else F.lit(None).cast("binary")).alias("_text"),  # a carried text is not held twice
    )
    whole = F.col("_text") if carried is None else F.coalesce(F.col(f"_carry.c{carried}"), F.lit("")).cast("binary")
    done: list[DataFrame] = []
    at, width = 0, first_width
    while True:
        digit = F.substring(whole, at + 1, width)
        rows = rows.withColumn("_key", F.struct("_group", digit.alias("_digit")))
        counts = (
            rows.groupBy("_key")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
            .filter("_n > 1")
            .withColumn("_next", F.monotonically_increasing_id())
        )
        counts = scratch.cut(counts, "groups", rows="_n")
        goes_on = F.col("_next").isNotNull() & (F.octet_length("_key._digit") == width)
        split = (
            join_keyed(rows, counts, "_key", rows="_n", how="left", keep=True, keys=min(HOT_KEYS, HOT_BYTES // width), hint="merge")
            .select(
                "_id",
                "_carry",
                "_sha",
                F.coalesce("_n", F.lit(1)).cast("long").alias("_n"),
                F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
                F.when(goes_on, F.col("_next")).alias("_next"),
                F.concat_ws("-", F.lit(str(len(done))), F.col("_next").cast("string")).alias("_class"),
                F.when(goes_on, F.col("_text")).alias("_text"),
            )
        )
        split = scratch.cut(split, "split")
        scratch.drop(counts)
        done.append(split.filter("_next is null").select("_id", "_carry", "_sha", "_n", "_keep", "_class"))
        rows = split.filter("_next is not null").select("_id", "_carry", "_sha", F.col("_next").alias("_group"), "_text")
        if rows.isEmpty():
            break
        at += width
        width = min(width * growth, MAX_WIDTH)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
