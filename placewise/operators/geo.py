"""Points in polygons, spread of addresses, near-duplicate addresses: equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .select import located

#: Fixed value: addresses this close are taken for one place written in two ways.
NEAR_METRES = 30.0


def polygon_edges(areas: DataFrame) -> DataFrame:
    """``(dauid, x1, y1, x2, y2)`` of areas with ``rings``."""
    rings = areas.select("dauid", F.explode("rings").alias("ring"))
    return rings.select("dauid", F.inline(C.ring_edges(F.col("ring"))))


def box_of(rings: Column) -> list[Column]:
    """Bounding box of rings, null without any."""
    points = F.flatten(rings)
    lon, lat = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return [
        F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"),
    ]


#: A power of four: cells of side 4 ** level. Edges are taken wider by this part of a cell, far above what arithmetic rounds.
LEAST_LEVEL, MOST_LEVEL, WIDER = -24, 8, 1.0 / 1024


def _shapes(areas: DataFrame, edges: DataFrame, carry: list[str]) -> DataFrame:
    """Areas with the side of their cells: about the square root of the number of edges by box side, so that an area has
    about as many cells as edges, of whatever size it is."""
    counts = edges.filter("y1 <> y2").groupBy("dauid").agg(F.count("*").alias("n"))
    shapes = areas.filter("min_lon is not null").select("dauid", *carry, "min_lon", "min_lat", "max_lon", "max_lat").join(counts, "dauid")
    side = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.ceil(F.log(F.greatest(side, F.lit(1e-300)) / F.greatest(F.floor(F.sqrt("n")), F.lit(1))) / math.log(4)).cast("int")
    shapes = shapes.withColumn("level", F.greatest(F.least(level, F.lit(MOST_LEVEL)), F.lit(LEAST_LEVEL))).withColumn("s", F.pow(F.lit(4.0), "level"))
    at = {"c0": "min_lon", "c1": "max_lon", "r0": "min_lat", "r1": "max_lat"}
    return shapes.withColumns({k: F.floor(F.col(v) / F.col("s")) for k, v in at.items()})


def cover(areas: DataFrame, edges: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(level, r, c, shapes)``: the cells of a grid of many sizes that areas lie in, each area in cells of its own size.

    A shape in a cell holds the edges that cross the cell's row within the cell, and of those that cross the row further
    east only what they add to a ray's crossings: whether an odd number of their ends lies north of the row
    (``odd``), and the latitudes within the row at which that changes (``flips``), which are few since the ends of edges that
    follow each other cancel. A cell without edges is inside or outside as a whole, and only the former is listed.
    """
    carry = carry or []
    shapes = _shapes(areas, edges, carry)
    e = edges.filter("y1 <> y2").join(shapes.select("dauid", "s", "c0", "c1", "r0", "r1"), "dauid")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.floor(low / F.col("s")), F.col("r0")), F.least(F.floor(high / F.col("s")), F.col("r1"))
    e = e.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    ends = [x_at(F.greatest(low, F.col("r") * F.col("s"))), x_at(F.least(high, (F.col("r") + 1) * F.col("s")))]
    wide, west, east = F.col("s") * WIDER, F.least("x1", "x2"), F.greatest("x1", "x2")
    e = e.withColumn("from", F.floor((F.greatest(F.least(*ends), west) - wide) / F.col("s")))
    e = e.withColumn("upto", F.floor((F.least(F.greatest(*ends), east) + wide) / F.col("s")))
    # East of a cell: what begins in a later column. Only a column's sums are kept, and the latitudes that do not cancel.
    e = e.withColumn("from", F.least("from", F.col("c1") + 1))
    top, bottom = (F.col("r") + 1) * F.col("s"), F.col("r") * F.col("s")
    key = ["dauid", "r", "c"]
    north = e.select("dauid", "r", (F.col("from") - 1).alias("c"), ((F.col("y1") >= top).cast("int") + (F.col("y2") >= top).cast("int")).alias("north"))
    inner = e.select("dauid", "r", "c0", "from", F.explode(F.array("y1", "y2")).alias("y"), top.alias("t"), bottom.alias("b")).filter("y > b and y < t")
    inner = inner.groupBy("dauid", "r", "y", "from").agg(F.count("*").alias("n"), F.first("c0").alias("c0")).filter("n % 2 = 1")
    w = Window.partitionBy("dauid", "r", "y").orderBy(F.desc("from"))
    inner = inner.withColumn("k", F.row_number().over(w)).withColumn("next", F.greatest(F.coalesce(F.lead("from").over(w), F.col("c0")), F.col("c0")))
    inner = inner.filter("k % 2 = 1 and next < `from`").select("dauid", "r", F.explode(F.sequence(F.col("next"), F.col("from") - 1)).alias("c"), F.col("y").alias("flip"))
    crossing = e.withColumn("a", F.greatest("from", "c0")).withColumn("z", F.least("upto", "c1")).filter("a <= z")
    crossing = crossing.select("dauid", "r", F.explode(F.sequence("a", "z")).alias("c"), F.struct("x1", "y1", "x2", "y2").alias("edge"))
    box = shapes.select("dauid", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("dauid", "r", F.explode(F.sequence("c0", "c1")).alias("c"), F.lit(0).alias("north"))
    parts = north.unionByName(box).unionByName(inner, allowMissingColumns=True).unionByName(crossing, allowMissingColumns=True)
    cells = parts.groupBy(*key).agg(F.sum("north").alias("north"), F.collect_list("flip").alias("flips"), F.collect_list("edge").alias("edges"))
    further = Window.partitionBy("dauid", "r").orderBy(F.desc("c"))  # a row of one area's cells
    cells = cells.withColumn("odd", F.coalesce(F.sum("north").over(further), F.lit(0)) % 2 == 1).filter("odd or size(edges) > 0 or size(flips) > 0")
    held = cells.select(*key, "odd", "flips", "edges").join(shapes.drop("n", "s", "r0", "r1"), "dauid").filter("c >= c0")
    shape = F.struct("dauid", *carry, "min_lon", "min_lat", "max_lon", "max_lat", "odd", "flips", "edges")
    return held.groupBy("level", "r", "c").agg(F.collect_list(shape).alias("shapes"))  # the few areas at a cell


def locate(rows: DataFrame, covered: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The rows (with ``lon`` and ``lat``) and ``block``, the area that holds their point by the even-odd rule, null if none.

    Holes are outside, islands in holes inside; of several areas the smallest id is taken. ``carry`` names columns of the
    area to return as ``block_<name>``. A null coordinate, and a zero one, is no point. ``covered`` is ``cover`` of the areas.

    Each different point looks up its cell of every size in use, of which there are at most ``MOST_LEVEL - LEAST_LEVEL + 1``.
    """
    carry = carry or []
    points = rows.select("lon", "lat").filter("lon <> 0 and lat <> 0").distinct()
    levels = F.broadcast(covered.select("level").distinct())  # so few, whatever the areas
    side = F.pow(F.lit(4.0), "level")
    points = points.crossJoin(levels).withColumn("r", F.floor(F.col("lat") / side)).withColumn("c", F.floor(F.col("lon") / side))
    in_box = lambda s: F.col("lon").between(s["min_lon"], s["max_lon"]) & F.col("lat").between(s["min_lat"], s["max_lat"])
    ray = lambda e: C.crosses(F.col("lon"), F.col("lat"), e["x1"], e["y1"], e["x2"], e["y2"])
    crossed = lambda s: s["odd"].cast("int") + F.size(F.filter(s["flips"], lambda y: y > F.col("lat"))) + F.size(F.filter(s["edges"], ray))
    hits = F.transform(F.filter("shapes", lambda s: in_box(s) & (crossed(s) % 2 == 1)), lambda s: F.struct(s["dauid"], *[s[c] for c in carry]))
    found = points.join(covered, ["level", "r", "c"]).select("lon", "lat", F.array_min(hits).alias("_hit")).filter("_hit is not null")
    found = found.groupBy("lon", "lat").agg(F.min("_hit").alias("_hit"))
    out = rows.join(found, ["lon", "lat"], "left")
    return out.select(*rows.columns, F.col("_hit.dauid").alias("block"), *[F.col(f"_hit.{c}").alias(f"block_{c}") for c in carry])


def containing_area(points: DataFrame, covered: DataFrame) -> DataFrame:
    """``(point, block)``: see ``locate``."""
    return locate(points.select("point", "lon", "lat"), covered).select("point", "block")


def call_points(calls: DataFrame) -> DataFrame:
    """Located calls in metres."""
    east, north = C.to_metres(F.col("latitude"), F.col("longitude"))
    return located(calls).select("request_id", "door", east.alias("x"), north.alias("y"))


#: Axes along which an address's extremes are taken.
AXES = [(math.cos(math.pi * k / 8), math.sin(math.pi * k / 8)) for k in range(8)]


def spreads(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., door, calls, spread)``: the largest distance between two calls of an address.

    Only points that can be an end of it are paired (``_ends``), and only with those of the same address.
    """
    from ..sources.layers import settled  # which needs ``box_of``

    keys = [*(by or []), "door"]
    east, north = C.to_metres(F.col("latitude"), F.col("longitude"))
    points = located(calls).select(*keys, east.alias("x"), north.alias("y")).groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    points = settled(points, "points")  # counts, extremes and both sides of the pairs are made of them
    counts = points.groupBy(*keys).agg(F.sum("n").alias("calls"))
    ends = _ends(points, keys)
    a, b = ends.alias("a"), ends.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    later = (F.col("a.x") < F.col("b.x")) | ((F.col("a.x") == F.col("b.x")) & (F.col("a.y") < F.col("b.y")))
    far = a.join(b, same & later).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys])
    far = far.agg(F.max(C.euclid(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("spread"))
    return counts.join(far, keys, "left").select(*keys, "calls", F.coalesce("spread", F.lit(0.0)).alias("spread"))


def _ends(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of distinct points, those that can be an end of their address's largest distance; none that is one is left out.

    The extremes along a few axes, found by partial aggregates, give distances that occur. A point's furthest partner lies
    within pi/16 of some axis, so it is no further than the extreme along that axis allows; a point whose bound falls short
    of a distance that occurs is no end.
    """
    along = [F.col("x") * c + F.col("y") * s for c, s in AXES]
    at = lambda p: F.struct(p.alias("p"), "x", "y")
    ends = points.groupBy(*keys).agg(
        *[F.max(at(p)).alias(f"hi{k}") for k, p in enumerate(along)], *[F.min(at(p)).alias(f"lo{k}") for k, p in enumerate(along)]
    )
    occurs = F.greatest(*[C.euclid(F.col(f"hi{k}.x") - F.col(f"lo{k}.x"), F.col(f"hi{k}.y") - F.col(f"lo{k}.y")) for k in range(len(AXES))])
    limits = ends.select(*keys, occurs.alias("occurs"), *[F.col(f"{e}{k}.p").alias(f"{e}{k}") for k in range(len(AXES)) for e in ("hi", "lo")])
    bound = F.greatest(*[d for k, p in enumerate(along) for d in (F.col(f"hi{k}") - p, p - F.col(f"lo{k}"))]) / math.cos(math.pi / 16)
    return points.join(limits, keys).filter(bound >= F.col("occurs") * (1 - 1e-9)).select(*keys, "x", "y")


def address_points(calls: DataFrame) -> DataFrame:
    """The upper-median point of each address, by axis."""
    points = call_points(calls).select("door", F.posexplode(F.array("x", "y")).alias("axis", "v"))
    values = points.groupBy("door", "axis", "v").agg(F.count("*").alias("n"))  # map-side counts: few rows an address
    w = Window.partitionBy("door", "axis").orderBy("v")
    upto = values.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("door", "axis")))
    middle = upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("door", "axis").agg(F.min("v").alias("v"))
    return middle.groupBy("door").agg(*[F.max(F.when(F.col("axis") == i, F.col("v"))).alias(c) for i, c in enumerate("xy")])


def _within(points: DataFrame, side: Column, radius: Column) -> DataFrame:
    """``(a, b, metres)`` of ``points`` (``door``, ``x``, ``y``) no further apart than ``radius``, which ``side`` is no less than: each looks
    in its own cell of that side and those around it."""
    points = points.withColumns({"cx": C.grid_cell(F.col("x"), side), "cy": C.grid_cell(F.col("y"), side), "radius": radius}).select("door", "x", "y", "cx", "cy", "radius")
    around = F.sequence(F.lit(-1), F.lit(1))
    left = points.select("door", "x", "y", F.explode(F.transform(around, lambda d: F.col("cx") + d)).alias("cx"), "cy")
    left = left.select("door", "x", "y", "cx", F.explode(F.transform(around, lambda d: F.col("cy") + d)).alias("cy"))
    a, b = left.alias("a"), points.alias("b")
    d = C.euclid(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.door") < F.col("b.door"))
    return a.join(b, same & (d <= F.col("b.radius"))).select(F.col("a.door").alias("a"), F.col("b.door").alias("b"), d.alias("metres"))


def near_pairs(calls: DataFrame, metres: float = NEAR_METRES) -> DataFrame:
    """Pairs of addresses within ``metres``."""
    return _within(address_points(calls), F.lit(2 * metres), F.lit(metres))


def spread_report(calls: DataFrame) -> DataFrame:
    """Addresses, those with several calls and their shares beyond 50 and 200 m, near pairs, addresses in them."""
    s = spreads(calls).agg(
        F.count("*").alias("addresses"),
        F.count_if(F.col("calls") > 1).alias("multi"),
        C.percent(F.count_if((F.col("calls") > 1) & (F.col("spread") > 50)), F.count_if(F.col("calls") > 1)).alias("over_50_pct"),
        C.percent(F.count_if((F.col("calls") > 1) & (F.col("spread") > 200)), F.count_if(F.col("calls") > 1)).alias("over_200_pct"),
    )
    ends = near_pairs(calls).select(F.explode(F.array("a", "b")).alias("door")).groupBy("door").agg(F.count("*").alias("n"))
    near = ends.agg(F.coalesce(F.floor(F.sum("n") / 2), F.lit(0)).alias("near_pairs"), F.count("*").alias("involved"))
    return s.crossJoin(F.broadcast(near))  # one row each


#: Sides of the cells in which addresses are counted for the closest pairs: the asked distance over powers of four, down to micrometres.
FINER = 12
#: Distances are told to the millimetre.
MILLIMETRE = 0.001


def _closest_radius(points: DataFrame, metres: float, pairs: int) -> DataFrame:
    """One row, ``radius``: a distance, at most ``metres``, within which there are ``pairs`` pairs if there are so many within ``metres``.

    A cell of side s with n points holds n (n - 1) / 2 pairs no further apart than its diagonal. Of the cell sizes at which
    there are enough such pairs, the least tells the radius; at the next size there are too few, so that points lie nearly
    all in cells of their own and a search within the radius meets a bounded number of others.
    """
    sides = F.array(*[F.lit(metres / 4**i) for i in range(FINER + 1)])
    cell = lambda c: C.grid_cell(F.col(c), F.col("side")).alias(f"c{c}")
    n = points.select("x", "y", F.explode(sides).alias("side")).select("side", cell("x"), cell("y")).groupBy("side", "cx", "cy").agg(F.count("*").alias("n")).filter("n > 1")
    enough = n.groupBy("side").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("held")).filter(F.col("held") >= pairs)
    return enough.agg(F.least(F.lit(metres), F.coalesce(F.min("side") * math.sqrt(2) + MILLIMETRE, F.lit(metres))).alias("radius"))


def nearest_pairs(calls: DataFrame, metres: float = NEAR_METRES, limit: int = 8) -> DataFrame:
    """The closest pairs of addresses within ``metres``, distances to the millimetre, ties by address.

    Only pairs within a radius that holds ``limit`` of them are made, whatever the addresses in a cell. Of addresses at one
    point the first ``limit + 1`` can be in such a pair, since each pair of a later one comes after as many others.
    """
    at_point = Window.partitionBy("x", "y").orderBy("door")
    points = address_points(calls).withColumn("k", F.row_number().over(at_point)).filter(F.col("k") <= limit + 1).drop("k")
    radius = F.broadcast(_closest_radius(points, metres, limit))  # one row
    pairs = _within(points.crossJoin(radius), F.col("radius"), F.col("radius")).filter(F.col("metres") <= metres)
    return pairs.withColumn("metres", F.bround("metres", 3)).orderBy("metres", "a", "b").limit(limit)


def spread_by(calls: DataFrame, by: str, beyond: float = 200.0) -> DataFrame:
    """Per group: addresses, those with several calls, and their share whose calls lie further apart than ``beyond`` metres."""
    several = F.col("calls") > 1
    return spreads(calls, [by]).groupBy(by).agg(
        F.count("*").alias("addresses"), F.count_if(several).alias("multi"),
        C.percent(F.count_if(several & (F.col("spread") > beyond)), F.count_if(several)).alias("over_200_pct"),
    )


def hour_histogram(local_calls: DataFrame) -> DataFrame:
    """``(channel, hour, calls)`` of calls with ``local`` and ``channel``; a null channel is '(none)'."""
    channel = F.coalesce("channel", F.lit("(none)")).alias("channel")
    return local_calls.filter("local is not null").groupBy(channel, F.hour("local").alias("hour")).agg(F.count("*").alias("calls"))


def hour_summary(histogram: DataFrame) -> DataFrame:
    """Per channel: calls, the peak hour (ties: the earliest) and the share from 21:00 to 07:00."""
    night = (F.col("hour") >= 21) | (F.col("hour") < 7)
    return histogram.groupBy("channel").agg(
        F.sum("calls").alias("total"),
        F.max_by("hour", F.struct("calls", -F.col("hour"))).alias("peak_hour"),
        C.percent(F.sum(F.when(night, F.col("calls")).otherwise(0)), F.sum("calls")).alias("night_pct"),
    )


def hour_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hours whose counts differ between two histograms."""
    x = a.withColumnRenamed("calls", "a")
    both = x.join(b.withColumnRenamed("calls", "b"), ["channel", "hour"], "full_outer")
    delta = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return both.select("channel", "hour", delta.alias("delta")).filter("delta <> 0")
