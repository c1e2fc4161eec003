"""Two copies of the data compared by row, field and rank; versions and their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..sources.layers import settled
from .select import residue_sample


#: The fields of a call that two copies are compared in; clocks that a derived list carries.
CALL_FIELDS = ["date_initiated", "date_closed", "description", "initiated_by", "priority", "address", "community", "district", "request_category",
               "resolution", "latitude", "longitude", "status", "dept_responsibility", "work_order"]
CLOCKS = ("derived_at", "last_sync_success_at", "most_recent_call_date")
RANKS = 4096


def row_diff(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """``(key.., change, field, a, b)``: rows in one copy only and fields that differ, nulls compared as values."""
    x = a.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*compare).alias("_a"))
    y = b.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(key)], F.struct(*compare).alias("_b"))
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_l{i}"))
    both = x.join(y, same, "full_outer")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    differ = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")),
                    F.struct(F.lit("changed").alias("change"), F.lit(c).alias("field"), text("_a", c).alias("a"), text("_b", c).alias("b")),
                )
                for c in compare
            ]
        )
    )
    none = F.lit(None).cast("string")
    whole = lambda w: F.array(F.struct(F.lit(w).alias("change"), none.alias("field"), none.alias("a"), none.alias("b")))
    found = F.when(F.col("_b").isNull(), whole("only_a")).when(F.col("_a").isNull(), whole("only_b")).otherwise(differ)
    keys = [F.coalesce(f"_k{i}", f"_l{i}").alias(k) for i, k in enumerate(key)]
    return both.select(*keys, F.inline(found))


BUCKETS = 4096


def bucket_digests(rows: DataFrame, key: list[str], compare: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n, a, b, c)``: checksums of the rows whose key falls into each bucket, in whatever order they come.

    The number of rows, a sum and two exclusive ors of 64-bit row hashes, nulls told from values: equal rows have equal checksums,
    and different ones have them by a chance far below one in 2 ** 100. Sums are combined before the shuffle, which takes a row per
    task and bucket.
    """
    said = [x for c in [*key, *compare] for x in (F.col(c), F.col(c).isNull())]
    one, two = F.xxhash64(*said), F.xxhash64(F.lit("second"), *reversed(said))
    rows = rows.select(bucket_of(key, buckets).alias("bucket"), one.alias("x"), two.alias("y"))
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(F.col("x").bitwiseXOR(F.col("y")), 20)).alias("a"), F.bit_xor("x").alias("b"), F.bit_xor("y").alias("c")
    )


def bucket_of(key: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*[x for c in key for x in (F.col(c), F.col(c).isNull())]), F.lit(buckets))


def unequal_buckets(a: DataFrame, b: DataFrame, key: list[str], compare: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``bucket``: those in which two copies differ, ``buckets`` at most. No row of the copies is joined."""
    return _unequal(bucket_digests(a, key, compare, buckets), bucket_digests(b, key, compare, buckets))


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumn("copy", F.lit(1)).unionByName(b.withColumn("copy", F.lit(2)))
    same = both.groupBy("bucket").agg(F.count("*").alias("copies"), *[F.count_distinct(c).alias(c) for c in "nabc"])
    return same.filter("copies < 2 or n > 1 or a > 1 or b > 1 or c > 1").select("bucket")


def bucketed_diff(a: DataFrame, b: DataFrame, key: list[str], compare: list[str], buckets: int = BUCKETS) -> DataFrame:
    """As ``row_diff``, for copies that are near alike: only rows of unequal buckets are shuffled and joined.

    Each copy is read twice, and all that is shuffled of equal ones is their checksums.
    """
    unequal = F.broadcast(unequal_buckets(a, b, key, compare, buckets))  # ``buckets`` numbers at most
    part = lambda rows: rows.withColumn("_bucket", bucket_of(key, buckets)).join(unequal, F.col("_bucket") == F.col("bucket"), "left_semi").drop("_bucket")
    return row_diff(part(a), part(b), key, compare)


def copies_agree(a: DataFrame, b: DataFrame, key: list[str], compare: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row: rows of either copy and whether they are equal, from checksums alone. These, ``buckets`` rows a copy, are
    written, so that each copy is read once."""
    a, b = (settled(bucket_digests(x, key, compare, buckets), "digests") for x in (a, b))
    rows = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    unequal = _unequal(a, b).agg((F.count("*") == 0).alias("agree"))
    return rows(a, "rows_a").crossJoin(F.broadcast(rows(b, "rows_b"))).crossJoin(F.broadcast(unequal))  # one row each


def id_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids in either copy, in both, only in one."""
    side = lambda df, name: df.select("request_id").withColumn(name, F.lit(1))
    sides = side(a, "a").unionByName(side(b, "b"), allowMissingColumns=True)
    by_id = sides.groupBy("request_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return by_id.agg(
        F.count("*").alias("either"), F.count_if(in_a & in_b).alias("common"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b")
    )


def clean_verdict(*diffs: DataFrame) -> DataFrame:
    """One row: the number of differences and whether there is none."""
    total = diffs[0].select(F.lit(1).alias("d"))
    for d in diffs[1:]:
        total = total.unionByName(d.select(F.lit(1).alias("d")))
    return total.agg(F.count("*").alias("differences")).withColumn("clean", F.col("differences") == 0)


def list_diff(a: DataFrame, b: DataFrame, key: str, compare: list[str] | None = None) -> DataFrame:
    """Lists with ``rank``: missing, extra, reordered (rank among the keys that both have) and cell differences.

    Without ``compare``, all columns that both lists have are compared, clocks of the run (``CLOCKS``) left out. A
    key's place among those of both lists is its rank less the keys of one list alone that rank before it. Those are
    few where lists are near alike; they are numbered, and counted by blocks of ``RANKS``, so no task sorts a list.
    """
    if compare is None:
        compare = [c for c in a.columns if c in b.columns and c not in (key, "rank", *CLOCKS)]
    cells = row_diff(a, b, [key], compare)
    cells = cells.withColumn("change", F.when(F.col("change") == "only_a", "missing").when(F.col("change") == "only_b", "extra").otherwise("cell"))

    def among_both(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        """``(key, name)``: places of my keys that the other list has, numbered without gaps."""
        ranks = mine.select(key, "rank").join(other.select(key), key, "left_semi").withColumn("_block", F.floor((F.col("rank") - 1) / RANKS))
        counts = ranks.groupBy("_block").agg(F.count("*").alias("_n"))
        before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row per block of ranks
        within = F.row_number().over(Window.partitionBy("_block").orderBy("rank"))
        return ranks.join(before, "_block").select(key, (F.col("_before") + within).alias(name))

    places = among_both(a, b, "pa").join(among_both(b, a, "pb"), key)
    moved = places.filter("pa <> pb").select(
        key, F.lit("reordered").alias("change"), F.lit("rank").alias("field"), F.col("pa").cast("string").alias("a"), F.col("pb").cast("string").alias("b")
    )
    return cells.unionByName(moved)


def version_sample(layer: str, rows: DataFrame, edited_at: str, retained: DataFrame | None = None, modulus: int = 128) -> DataFrame:
    """``(layer, edited_at, business_key, object_id)`` of a residue class; nothing if the version is retained."""
    key = "request_id" if layer != "census_areas" else "object_id"
    sample = residue_sample(rows, modulus, key).select(
        F.lit(layer).alias("layer"), F.lit(edited_at).cast("timestamp_ntz").alias("edited_at"), C.business_key(layer).alias("business_key"), "object_id"
    )
    return sample if retained is None else sample.join(retained, ["layer", "edited_at"], "left_anti")


def version_identity(rows: DataFrame) -> DataFrame:
    """Row count and highest object id."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.max("object_id"), F.lit(0)).alias("max_object_id"))


def renumbering(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One row: sampled records in both versions, those that kept and changed their object id, those in one, and a verdict."""
    o, n = older.select("business_key", F.col("object_id").alias("was")), newer.select("business_key", F.col("object_id").alias("now"))
    both = o.join(n, "business_key", "full_outer")
    shared = F.col("was").isNotNull() & F.col("now").isNotNull()
    out = both.agg(
        F.count_if(shared).alias("shared"), F.count_if(shared & (F.col("was") == F.col("now"))).alias("kept"),
        F.count_if(shared & (F.col("was") != F.col("now"))).alias("moved"),
        F.count_if(F.col("now").isNull()).alias("only_in_older"), F.count_if(F.col("was").isNull()).alias("only_in_newer"),
    )
    verdict = (
        F.when(F.col("shared") == 0, "no_shared_keys").when(F.col("moved") == 0, "preserved").when(F.col("kept") == 0, "reassigned")
        .otherwise("partially_reassigned")
    )
    return out.withColumn("verdict", verdict)


def moved_examples(older: DataFrame, newer: DataFrame, limit: int = 5) -> DataFrame:
    """The first renumbered records by key."""
    o, n = older.select("business_key", F.col("object_id").alias("was")), newer.select("business_key", F.col("object_id").alias("now"))
    return o.join(n, "business_key").filter("was <> now").orderBy("business_key").limit(limit)


def retained_versions(versions: DataFrame) -> DataFrame:
    """A layer's versions with their ``position``, oldest first, those without an edit time before all."""
    order = Window.partitionBy("layer").orderBy(F.asc_nulls_first("edited_at"), "version_id")
    return versions.withColumn("position", F.row_number().over(order)).orderBy("layer", "position")


def advanced(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(layer, observed, pulled, advanced)``: an edit newer than the last one pulled, or none pulled yet."""
    both = observed.join(baseline, "layer", "left")
    newer = F.coalesce(F.col("observed") > F.col("pulled"), F.col("observed").isNotNull())
    return both.select("layer", "observed", "pulled", newer.alias("advanced"))


def stored_counts(rows: DataFrame) -> DataFrame:
    """``(layer, stored)`` of a table partitioned by layer."""
    return rows.groupBy("layer").agg(F.count("*").alias("stored"))


def count_check(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Layers whose stored and published counts differ, as anomaly rows."""
    both = stored.join(source, "layer").filter("stored <> published")
    detail = F.create_map(F.lit("stored"), F.col("stored").cast("string"), F.lit("published"), F.col("published").cast("string"))
    return both.select("layer", F.lit("count_divergence").alias("kind"), detail.alias("detail"))


def republished(before: DataFrame, after: DataFrame) -> DataFrame:
    """Layers whose edit time changed between two reads, those in one read alone too."""
    x, y = before.select("layer", F.col("edited_at").alias("before")), after.select("layer", F.col("edited_at").alias("after"))
    return x.join(y, "layer", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def reconciled(runs: DataFrame, layers: DataFrame) -> DataFrame:
    """``(layer, reconciled)``: the newest recorded outcome of runs that did not fail; null if none is recorded."""
    good = runs.filter("error is null and reconciled is not null")
    newest = good.groupBy("layer").agg(F.max_by("reconciled", "started_at").alias("reconciled"))
    return layers.join(newest, "layer", "left")


def all_reconciled(by_layer: DataFrame) -> DataFrame:
    return by_layer.agg(F.every(F.coalesce("reconciled", F.lit(False))).alias("reconciled"))


def last_pulled(runs: DataFrame, state: DataFrame) -> DataFrame:
    """``(layer, pulled)``: the edit of the newest successful load, else the layer state's if a load ever completed."""
    loads = runs.filter("kind in ('full_load', 'reload') and error is null and finished_at is not null")
    newest = loads.groupBy("layer").agg(F.max_by("source_edit", F.struct("finished_at", "run_id")).alias("from_run"))
    fallback = F.when(F.col("full_load_completed_at").isNotNull(), F.col("source_last_edit"))
    return state.join(newest, "layer", "left").select("layer", F.coalesce("from_run", fallback).alias("pulled"))


def may_derive(runs: DataFrame, layers: list[str]) -> DataFrame:
    """One row: false if the newest run of a call layer failed or is missing."""
    newest = runs.filter(F.col("layer").isin(layers)).groupBy("layer").agg(F.max_by(F.col("error").isNull(), "started_at").alias("ok"))
    return newest.agg((F.count_if("ok") == len(layers)).alias("may_derive"))
