"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code is the sign bit of each dimension, held in words of 64 bits. Codes are cut into m segments of about
log2(number of codes) bits, so that a segment has about as many keys as there are codes. Two codes within distance r
agree up to r // m bits in at least one segment. Round s looks up all keys at distance s from a query's own in
each segment; then every code within distance m * (s + 1) - 1 has been met, and a query is finished once its k-th
verified distance is no larger. Unfinished queries go to the next round with that distance as a bound: codes beyond it
are dropped where they are met, and the last round searches just the segments that its cover needs.

A pair is taken once, in the round of its least segment distance and the first segment that has it; both codes tell,
so nothing met before is kept or compared. A query's state is its k + 1 best rows, written after each round.

Codes that many vectors share are searched once: the index holds distinct codes with the k + 1 smallest ids of
each (a partial top-k before the shuffle), and queries of one code share their search, whose result goes to them where they lie
if they are many. Keys of more than HOT_KEY codes are dealt over several tasks by salts.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, join_keyed, small

WORD = 64
#: A round's masks are at most comb(20, 10) = 184,756 rows, which bounds their broadcast.
MOST_BITS = 20
HOT_KEY = 10_000


def code_of(vector: Column, dims: int) -> list[Column]:
    """Sign bits as words of 64 bits; null and missing elements count as not positive."""
    words = []
    for lo in range(0, dims, WORD):
        bits = [
            F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.shiftleft(F.lit(1).cast("long"), i - lo)).otherwise(F.lit(0).cast("long"))
            for i in range(lo, min(lo + WORD, dims))
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return words


def segments_of(dims: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, lowest bit, bits) of each segment, for an index of ``codes`` distinct codes."""
    width = min(max(codes.bit_length() - 1, 4), MOST_BITS)
    cuts = []
    for word, lo in enumerate(range(0, dims, WORD)):
        held = min(WORD, dims - lo)
        parts = -(-held // width)
        edges = [held * i // parts for i in range(parts + 1)]
        cuts += [(word, a, b - a) for a, b in zip(edges, edges[1:])]
    return cuts


def _part(word: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(words: list[str], cuts: list[tuple[int, int, int]]) -> Column:
    """An array of (seg, bits, key)."""
    return F.array(*[
        F.struct(F.lit(i).alias("seg"), F.lit(bits).alias("bits"), _part(F.col(words[w]), low, bits).alias("key"))
        for i, (w, low, bits) in enumerate(cuts)
    ])


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, rank, neighbor_id, distance)``: for rows where ``queries`` holds, the k nearest other rows by
    (distance, id), over all rows.

    ``dims`` is the number of leading dimensions used. A row with a null vector or id is neither query nor
    neighbour; missing dimensions count as not positive. Rows that repeat an id are one (their smallest code). With
    k rows or fewer, a query gets all others. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming")
    words = [f"w{i}" for i in range(-(-dims // WORD))]
    rows = vectors.select(
        vectors[id_col].cast("long").alias("id"),
        F.struct(*[c.alias(w) for w, c in zip(words, code_of(vectors[vector_col], dims))]).alias("code"),
        F.coalesce(queries, F.lit(False)).alias("q"), vectors[vector_col].isNotNull().alias("ok"),
    ).filter("id is not null and ok")
    rows = rows.groupBy("id").agg(F.min("code").alias("code"), F.max("q").alias("q")).select("id", "code.*", "q")
    rows = scratch.cut(rows, "codes")
    by_id = Window.partitionBy(*words).orderBy("id")
    firsts = rows.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    index = scratch.cut(firsts.groupBy(*words).agg(F.array_sort(F.collect_list("id")).alias("ids")), "index")
    size = index.agg(F.count("*").alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    cuts = segments_of(dims, size["codes"])
    m = len(cuts)

    segments = index.select(*words, "ids", F.inline(_keys(words, cuts)))
    hot = segments.groupBy("seg", "key").count().filter(F.col("count") > HOT_KEY)
    hot = scratch.cut(hot.select("seg", "key", F.ceil(F.col("count") / HOT_KEY).cast("int").alias("salts")), "hot")
    hot = None if hot.isEmpty() else small(hot)
    if hot is None:
        segments = segments.withColumn("salt", F.lit(0))
    else:
        salt = F.coalesce(F.pmod(F.xxhash64(*words), F.col("salts")), F.lit(0)).cast("int")
        segments = segments.join(hot, ["seg", "key"], "left").withColumn("salt", salt)
    segments = scratch.cut(segments.select("seg", "key", "salt", "ids", *[F.col(w).alias(f"x{w}") for w in words]), "segments")

    asked = rows.filter("q").select("id", *words)
    todo = asked.select(*words).distinct().withColumn("hi", F.lit(None).cast("int"))
    by_code = Window.partitionBy(*words)
    apart = [F.bit_count(_part(F.col(words[w]).bitwiseXOR(F.col(f"x{words[w]}")), low, bits)) for w, low, bits in cuts]
    best = None
    done: list[DataFrame] = []
    longest = max(bits for _, _, bits in cuts)
    for radius in range(longest + 1):
        masks = spark.range(1 << longest).filter(F.bit_count("id") == radius).select(F.col("id").alias("mask"))
        widths = F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(1 << b).alias("end")) for b in sorted({bits for _, _, bits in cuts})])
        masks = masks.select("mask", F.inline(widths)).filter("mask < end").drop("end")
        probes = todo.select(*words, "hi", F.inline(_keys(words, cuts)))
        probes = probes.filter(F.col("hi").isNull() | (F.col("seg") <= F.col("hi") - m * radius))
        probes = probes.join(F.broadcast(masks), "bits").select(*words, "hi", "seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
        if hot is None:
            probes = probes.withColumn("salt", F.lit(0))
        else:
            salts = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
            probes = probes.join(hot, ["seg", "key"], "left").withColumn("salt", F.explode(salts)).drop("salts")
        met = probes.hint("merge").join(segments, ["seg", "key", "salt"])
        first = reduce(and_, [x >= F.when(F.col("seg") > i, radius + 1).otherwise(radius) for i, x in enumerate(apart)])
        met = met.filter(first).withColumn("distance", reduce(add, apart).cast("int"))
        met = met.filter(F.col("hi").isNull() | (F.col("distance") <= F.col("hi")))
        met = met.select(*words, "distance", F.explode("ids").alias("neighbor_id"))
        if best is not None:
            met = met.unionByName(best.select(*words, "distance", "neighbor_id"))
        # A query's own row is not its neighbour, so k + 1 rows must lie within the distance that is covered.
        near = met.withColumn("r", F.row_number().over(by_code.orderBy("distance", "neighbor_id"))).filter(F.col("r") <= k + 1)
        near = near.withColumn("n", F.count("*").over(by_code)).withColumn("far", F.max("distance").over(by_code)).drop("r")
        near = scratch.cut(near, f"round{radius}")
        covered = m * (radius + 1) - 1
        over = (F.col("n") >= size["ids"]) | ((F.col("n") > k) & (F.col("far") <= covered)) | F.lit(radius == longest)
        done.append(near.filter(over))
        best = near.filter(~over)
        if best.isEmpty():
            break
        todo = best.groupBy(*words).agg(F.max(F.when(F.col("n") > k, F.col("far"))).alias("hi"))
    found = reduce(DataFrame.unionByName, done).groupBy(*words)
    found = found.agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))  # k + 1 at most
    counts = asked.groupBy(*words).agg(F.count("*").alias("rows"))
    found = scratch.cut(found.join(counts, words), "found", rows="rows")
    others = F.slice(F.filter("near", lambda n: n["neighbor_id"] != F.col("id")), 1, k)
    out = join_keyed(asked, found, words).select("id", F.posexplode(others).alias("at", "n"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("rank"), "n.neighbor_id", "n.distance")
