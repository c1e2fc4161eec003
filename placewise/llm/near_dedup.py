"""Near duplicates on word shingles: fast similarity sketches, banding, exact verification.

Sketch. Each shingle set gets T coordinates. In round i < T every shingle is hashed to one random bin and
a value; in round i >= T every shingle goes to bin i - T. A coordinate keeps the least (round, value), and
a set stops after the first round that leaves no coordinate empty. All coordinates are filled by round 2T
at the latest, and the share of agreeing coordinates of two sets estimates their Jaccard similarity with
the concentration of independent min-hashes (Dahlgaard, Knudsen and Thorup, "Fast similarity sketching").

Candidates. Documents of one shingle set form a class with one representative. Sketches are cut into
bands; two representatives with an equal band are candidates. A bucket first tests its members against its
smallest one; what that links needs no further test. Members of a bucket that are still in different
components are then tested with each other in blocks of bounded size, which return a spanning forest of the
links that they verify, so no step emits a bucket's pairs. No candidate is dropped by a cap.

Verification. Shingle sets of the candidates' whole texts are built again and intersected.

Hot keys. A band, a hub or a set that very many rows share is joined where those rows lie or dealt over salts
(``join_keyed``, ``_confirm``), and blocks are bounded in members and in bytes, so no task holds a group.

So the bands alone can miss a pair: with 32 bands of 4, a pair at similarity 0.85 is no candidate with
probability (1 - 0.85^4)^32, below 1e-10 (at 0.80, below 1e-7).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT_ROWS, Scratch, hot_limit, join_keyed, seen, short_batches, slices, small

WORDS = 5
COORDS = 128
WORD_TABLE = 150_000
ROWS = 4
BLOCK = 512
BLOCK_BYTES = 32 << 20
GROUP = 1000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those met before come from a table of bounded size."""
    import xxhash

    get = _words.get
    out = [get(w) for w in words]
    if None in out:
        if len(_words) > WORD_TABLE:
            _words.clear()
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, ASCII white space splits)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = _word_hashes(parts)
    width = min(words, len(parts))
    n = len(parts) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            out = _mix(out * _SEED + h[k : k + n])
    return np.unique(out)


def sketch(hashes: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The set's coordinates as 32-bit values; equal where round and value are equal."""
    least = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    if len(hashes):
        with np.errstate(over="ignore"):
            step = max(1, 512 // len(hashes))
            i = 0
            while i < 2 * coords:
                rounds = np.arange(i, min(i + step, 2 * coords), dtype=np.uint64)
                h = _mix(hashes[None, :] + (rounds[:, None] + np.uint64(1)) * _SEED)
                for k, r in enumerate(rounds.tolist()):
                    row = h[k]
                    value = (np.uint64(r) << np.uint64(48)) | (row >> np.uint64(16))
                    if r < coords:
                        bins = ((row & np.uint64(0xFFFF)) * np.uint64(coords) >> np.uint64(16)).astype(np.int64)
                        np.minimum.at(least, bins, value)
                    else:
                        least[r - coords] = min(least[r - coords], value.min())
                    if (least != np.iinfo(np.uint64).max).all():
                        return _mix(least).astype(np.uint32)
                i += step
    return _mix(least).astype(np.uint32)


def _sketched(words: int, coords: int):
    def run(batches):
        for batch in slices(batches):
            n, key, sk = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                key.append(_digest(s) if len(s) else None)
                sk.append(sketch(s, coords).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sk, pa.binary())],
                names=["id", "sha", "n", "key", "sk"],
            )

    return run


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(words: int):
    """``(node, hashes)`` of the rows whose set is that of the node; a row that shares its id with another text drops out."""

    def run(batches):
        for batch in slices(batches):
            nodes, sets = [], []
            for t, node, key in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "key")), strict=True):
                s = shingle_set(t, words)
                if _digest(s) == key:
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def _linked(threshold_pct: int):
    """Pairs whose sets have 100 * intersection >= threshold * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(a, b)
                if 100 * common >= threshold_pct * (len(a) + len(b) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _may_link(n, m, threshold_pct: int):
    """Whether sets of these sizes can be linked: their intersection is at most the smaller, their union at least the larger."""
    return 100 * np.minimum(n, m) >= threshold_pct * np.maximum(n, m)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _forest(threshold_pct: int, coords: int, rows: int):
    """Of the buckets in a group: links between left and right members of different components.

    Pairs are verified on full sets in the first band they share; of the links found, a spanning forest is
    returned, so the rows returned are fewer than the members.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("band")
        bands, side = table["band"].to_numpy(), table["side"].to_numpy()
        ids, comp, at_band = table["id"].to_numpy(), table["comp"].to_numpy(), table["at"].to_numpy()
        sk = np.frombuffer(b"".join(table["sk"].to_pylist()), np.uint32).reshape(-1, coords)
        sets = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        sizes = np.array([len(h) for h in sets], np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: set[tuple[int, int]] = set()
        starts = np.flatnonzero(np.r_[True, bands[1:] != bands[:-1]]) if len(bands) else []
        for lo, hi in zip(starts, [*starts[1:], len(bands)], strict=True):
            part = np.arange(lo, hi)
            right = part[side[part] == 1]
            for i in part[side[part] == 0]:
                near = right[_may_link(sizes[right], sizes[i], threshold_pct) & (comp[right] != comp[i])]
                if len(near):
                    first = (sk[near] == sk[i]).reshape(len(near), -1, rows).all(axis=2).argmax(axis=1)
                    for j in near[first == at_band[i]]:
                        x, y = root(int(comp[i])), root(int(comp[j]))
                        if x == y:
                            continue
                        common = _common(sets[i], sets[j])
                        if 100 * common >= threshold_pct * (len(sets[i]) + len(sets[j]) - common):
                            parent[max(x, y)] = min(x, y)
                            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star operations; each round is written, and the edges shrink to stars
    in a logarithmic number of rounds.
    """
    e = scratch.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("rows")), "least", "rows")
        large = join_keyed(both.filter("b > a"), least, "a").select(F.col("m").alias("a"), "b")
        large = scratch.cut(large.filter("a <> b").distinct(), "large")
        lower = scratch.cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("rows")), "lower", "rows")
        star = join_keyed(large, lower, "b")
        star = (
            star.select(F.col("m").alias("a"), "b")
            .unionByName(star.select(F.col("m").alias("a"), F.col("a").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        star = scratch.cut(star, "small", sum=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now = (seen(star)["count"], seen(star)["sum"])
        scratch.drop(e, least, large, lower)
        e = star
        if now == before:
            break
        before = now
    nodes = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold_pct: int = 80,
    words: int = WORDS,
    coords: int = COORDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``kept``.

    Links texts whose shingle sets have 100 * intersection >= threshold_pct * union. A text of fewer than ``words``
    words is one shingle; a null text, or one without words, has none and is linked with nothing. ``component_id``
    is the smallest id reachable, ``kept`` says that it is the row's own. Rows that repeat id and text are all
    kept or not; rows that share an id but not the text are linked each by its own text. A null id is linked with
    nothing and kept, its component null. Ids must be integers. An empty table gives no rows.
    """
    rows_ = _components(docs, id_col, text_col, threshold_pct, words, coords, rows)
    return rows_.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = 80, words: int = WORDS) -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with their own columns.

    Null and empty texts are linked with nothing and stay. Of rows that repeat an id with equal or linked texts, those that
    ``near_duplicates`` marks as kept all stay. An empty table gives no rows.
    """
    gone = _components(docs, id_col, text_col, threshold_pct, words, COORDS, ROWS).filter("not kept")
    gone = small(Scratch(docs.sparkSession, "dropped").cut(gone.select("id", "sha").distinct(), "ids"))
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    return docs.join(gone, (docs[id_col].cast("long") == gone["id"]) & (sha == gone["sha"]), "left_anti")


def _components(docs: DataFrame, id_col: str, text_col: str, threshold_pct: int, words: int, coords: int, rows: int) -> DataFrame:
    """``(id, sha, n, component, kept)`` for each row; ``sha`` tells the texts of one id apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    short_batches(spark)
    text = docs[text_col].cast("string")
    narrow = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"))
    s = scratch.cut(narrow.mapInArrow(_sketched(words, coords), "id long, sha string, n long, key binary, sk binary"), "sketches")
    classes = (
        s.filter("id is not null and key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.min_by("sk", "id").alias("sk"), F.first("n").alias("n"), F.count("*").alias("rows"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    reps = scratch.cut(classes, "classes")  # nodes are numbered once, as this is written

    size = 4 * rows
    parts = F.array(
        *[
            F.xxhash64(F.lit(i), F.substring("sk", i * size + 1, size)) for i in range(coords // rows)
        ]
    )
    bands = scratch.cut(reps.select("node", F.posexplode(parts).alias("at", "band")), "bands")
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    hubs = scratch.cut(hubs, "hubs", "members")
    stars = scratch.cut(join_keyed(bands, hubs, "band", "members", keep=True), "stars")
    scratch.drop(bands)
    pairs = stars.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirm(pairs, reps, narrow, scratch, threshold_pct, words)
    comps = scratch.cut(connected_components(links, scratch), "components")

    # What the stars leave open: members of one bucket in different components, neither of them its hub.
    def in_component(df: DataFrame, col: str, name: str) -> DataFrame:
        c = comps.select(F.col("node").alias(col), F.col("component").alias("_c"))
        return df.join(c, col, "left").withColumn(name, F.coalesce("_c", col)).drop("_c")

    large = hubs.filter("members > 2").select("band", "hub", F.col("members").alias("rows"))
    mains = scratch.cut(in_component(large, "hub", "main"), "mains", "rows")
    members = in_component(stars.filter("members > 2").select("band", "at", "node"), "node", "comp")
    members = scratch.cut(join_keyed(members, mains, "band").filter("node <> hub"), "members")
    open_ = (
        members.groupBy("band")
        .agg(F.count_if(F.col("comp") != F.col("main")).alias("others"), F.count(F.lit(1)).alias("rest"))
        .filter("others > 0 and rest > 1")
    )
    members = scratch.cut(join_keyed(members, scratch.cut(open_, "open-bands", "rest"), "band", "rest", keep=True), "open")
    sets = _shingles(narrow, reps, members.select("node").distinct(), words, scratch)
    held = scratch.cut(members.join(reps.select("node", "sk", "n"), "node"), "held")
    other = F.col("comp") != F.col("main")
    bytes_ = held.groupBy("band").agg(
        F.sum(F.when(other, F.col("n")).otherwise(0)).alias("other_n"), F.sum("n").alias("rest_n"), F.count("*").alias("rows")
    )
    bytes_ = scratch.cut(bytes_, "bytes", "rows", rest_n=F.sum("rest_n"))
    held = join_keyed(held, bytes_, "band")
    blocks_of = lambda count, n: F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(8 * F.col(n) / BLOCK_BYTES), F.lit(1)).cast("int")
    lefts, rights = blocks_of("others", "other_n"), blocks_of("rest", "rest_n")
    groups = max(1, seen(bytes_)["total"] // GROUP, 8 * seen(bytes_)["rest_n"] // BLOCK_BYTES)
    group = F.when((lefts > 1) | (rights > 1), F.col("band"))
    group = F.coalesce(group, F.pmod("band", F.lit(groups)))  # small buckets share a group
    mine = F.xxhash64("node")
    cols = [group.alias("group"), "band", "at", "node", "comp", "sk"]
    left = held.filter(other).select(
        *cols, F.lit(0).alias("side"), F.pmod(mine, lefts).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"),
    )
    right = held.select(
        *cols, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"),
        F.pmod(mine, rights).cast("int").alias("j"),
    )
    blocks = left.unionByName(right).join(sets, "node").withColumnRenamed("node", "id").groupBy("group", "i", "j")
    more = scratch.cut(blocks.applyInArrow(_forest(threshold_pct, coords, rows), "a long, b long").distinct(), "more")
    if seen(more)["count"]:
        contracted = in_component(in_component(more, "a", "ca"), "b", "cb").select(
            F.col("ca").alias("a"), F.col("cb").alias("b")
        )
        merged = scratch.cut(connected_components(contracted.filter("a <> b"), scratch), "merged")
        comps = (
            comps.unionByName(merged.select("node", F.col("node").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component"))
            .join(merged.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left")
            .select("node", F.coalesce("_c", "component").alias("component"))
        )
    scratch.drop(stars, members, held, sets)

    # A component is known by its smallest id; of its rows, those of one text share a class.
    named = reps.select("node", "key", "rep", "rows").join(comps, "node", "left")
    named = scratch.cut(named.select("key", "rep", "rows", F.coalesce("component", "node").alias("c")), "named")
    least = scratch.cut(named.groupBy("c").agg(F.min("rep").alias("component"), F.count("*").alias("_n")), "least", "_n")
    named = scratch.cut(join_keyed(named, least, "c", "_n").select("key", "component", "rows"), "named-by-id", "rows")
    known = F.col("id").isNotNull() & F.col("key").isNotNull()
    out = join_keyed(s.filter(known).select("id", "sha", "n", "key"), named, "key").drop("key")
    alone = s.filter(~known).select("id", "sha", "n", F.col("id").alias("component"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _confirm(pairs: DataFrame, reps: DataFrame, narrow: DataFrame, scratch: Scratch, threshold_pct: int, words: int) -> DataFrame:
    """The pairs that hold on full shingle sets. Pairs of a hub with very many members are dealt over salts, and its set
    goes to each, so that the members' sets do not meet in one task."""
    pairs = scratch.cut(pairs, "pairs")
    counts = scratch.cut(pairs.groupBy("a").agg(F.count("*").alias("rows")), "counts", "rows")
    limit, any_hot = hot_limit(counts)
    nodes = counts.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _shingles(narrow, reps, nodes, words, scratch)
    mine, its = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    on = ["a"]
    if any_hot:
        on = ["a", "salt"]
        hot = F.broadcast(counts.filter(F.col("rows") > limit).select("a", F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("salts")))
        pairs = pairs.join(hot, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        mine = mine.join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    tested = pairs.join(its, "b").join(mine, on)
    links = scratch.cut(
        tested.select("a", "b", "y", "x").mapInArrow(_linked(threshold_pct), "a long, b long"), "links"
    )
    scratch.drop(counts, sets)
    return links


def _shingles(narrow: DataFrame, reps: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """``(node, hashes)``: the shingle sets of the classes in ``nodes``."""
    wanted = scratch.cut(reps.select("node", "key", F.col("rep").alias("id")).join(nodes, "node"), "wanted")
    sets = narrow.select("id", "text").join(small(wanted), "id").mapInArrow(_sets(words), "node long, hashes binary")
    return scratch.cut(sets.dropDuplicates(["node"]), "sets")
