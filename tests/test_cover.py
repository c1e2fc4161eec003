"""Areas of very different sizes, in cells of several sizes, against the plain even-odd test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators import geo

EDGES = "dauid string, x1 double, y1 double, x2 double, y2 double"
AREAS = "dauid string, dwellings int, min_lon double, min_lat double, max_lon double, max_lat double"


def star(cx, cy, size, n, rnd):
    """A ring of n vertices around a centre, some of them on round numbers."""
    out = []
    for k in range(n):
        d, a = size * rnd.uniform(0.3, 1), 2 * math.pi * k / n
        x, y = cx + d * math.cos(a), cy + d * math.sin(a)
        out.append((round(x, 1), round(y, 1)) if rnd.random() < 0.2 and size > 1 else (x, y))
    return out


def edges_of(rings):
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def inside(edges, lon, lat):
    odd = False
    for x1, y1, x2, y2 in edges:
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


def tables(spark, shapes):
    edges = {i: edges_of(r) for i, r in shapes.items()}
    box = {i: (min(e[0] for e in v), min(e[1] for e in v), max(e[0] for e in v), max(e[1] for e in v)) for i, v in edges.items()}
    areas = spark.createDataFrame([(i, 1, *map(float, box[i])) for i in shapes] + [("none", 0, None, None, None, None)], AREAS)
    return edges, box, areas, spark.createDataFrame([(i, *map(float, e)) for i, v in edges.items() for e in v], EDGES)


def expected(edges, box, lon, lat):
    if lon is None or lat is None or lon == 0 or lat == 0:
        return None
    hit = [i for i, (a, b, c, d) in box.items() if a <= lon <= c and b <= lat <= d and inside(edges[i], lon, lat)]
    return min(hit, default=None)


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_plain_test(spark, seed):
    rnd = random.Random(seed)
    shapes = {"province": [star(0, 0, 90, 400, rnd), square(-20, -20, 16), square(-16, -16, 4)], "thin": [[(1.0, 1.0), (80.0, 1.25), (80.0, 1.5)]]}
    shapes |= {f"b{i}": [star(rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0.01, 0.5, 3, 20]), rnd.choice([3, 4, 9, 60]), rnd)] for i in range(60)}
    shapes |= {f"s{i}{j}": [square(float(4 * i), float(4 * j), 4.0)] for i in range(-3, 4) for j in range(-3, 4)}
    edges, box, areas, rows = tables(spark, shapes)
    points = [(rnd.uniform(-95, 95), rnd.uniform(-95, 95)) for _ in range(1500)] + [(float(rnd.randint(-20, 20)), float(rnd.randint(-20, 20))) for _ in range(400)]
    points += [(x, y) for e in edges["province"][:150] for x, y in ((e[0], e[1]), ((e[0] + e[2]) / 2, (e[1] + e[3]) / 2))]
    points += [(e[0] + rnd.uniform(-0.02, 0.02), e[1] + rnd.uniform(-0.02, 0.02)) for i in range(60) for e in edges[f"b{i}"][:4]] + [(None, 1.0), (0.0, 2.0), (1.0, None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point int, lon double, lat double")
    got = {r.point: r.block for r in geo.containing_area(df, geo.cover(areas, rows)).collect()}
    want = {k: expected(edges, box, *p) for k, p in enumerate(points)}
    assert got == want and len({v for v in want.values() if v}) > 20


def test_a_province_and_ten_thousand_blocks(spark):
    rnd = random.Random(5)
    shapes = {"province": [star(0, 0, 60, 20_000, rnd)]} | {f"b{i:05d}": [star(i % 100 * 0.01 + 1, i // 100 * 0.01 + 1, 0.005, 12, rnd)] for i in range(10_000)}
    edges, box, areas, rows = tables(spark, shapes)
    covered = geo.cover(areas, rows).cache()
    held = covered.select("level", F.explode("shapes").alias("s"))
    by = {r.level: r for r in held.groupBy("level").agg(F.sum(F.size("s.edges")).alias("edges"), F.max(F.size("s.edges")).alias("most"), F.sum(F.size("s.flips")).alias("flips"), F.count("*").alias("cells")).collect()}
    total = sum(map(len, edges.values()))
    assert len(by) >= 2 and sum(r.edges for r in by.values()) < 5 * total and sum(r.cells for r in by.values()) < 4 * total
    assert max(r.most for r in by.values()) < 2 * 20_000**0.5 and sum(r.flips for r in by.values()) < 8 * total
    points = [(rnd.uniform(0.9, 2.1), rnd.uniform(0.9, 2.1)) for _ in range(300)] + [(rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for _ in range(50)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point int, lon double, lat double")
    got = {r.point: r.block for r in geo.containing_area(df, covered).collect()}
    assert got == {k: expected(edges, box, *p) for k, p in enumerate(points)}
    covered.unpersist()
