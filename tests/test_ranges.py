"""Distances by a grid cover against distances from every edge."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldsense.functions import geo

EDGES = "code string, part int, x1 double, y1 double, x2 double, y2 double"


def ring(code, part, corners):
    return [(code, part, *map(float, a), *map(float, b)) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def star(rnd, x, y, size, n):
    """Corners at random distances around (x, y): a polygon with n edges."""
    return [(x + (r := size * rnd.uniform(0.3, 1)) * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def plain(x, y, edges):
    """Distance from the nearest of all edges, 0 inside of any part."""
    best, crossings = math.inf, {}
    for _, part, x1, y1, x2, y2 in edges:
        dx, dy = x2 - x1, y2 - y1
        t = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-12)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        if (y1 > y) != (y2 > y) and x < x1 + dx * (y - y1) / dy:
            crossings[part] = crossings.get(part, 0) + 1
    return 0.0 if any(n % 2 for n in crossings.values()) else best


def world(seed):
    rnd = random.Random(seed)
    edges = []
    for code in "abc":
        for part in range(3):
            cx, cy, size = rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.uniform(3, 30)
            edges += ring(code, part, star(rnd, cx, cy, size, rnd.choice([3, 40, 300])))
            if part == 1:  # a hole
                edges += ring(code, part, star(rnd, cx, cy, size * 0.25, 12))
    edges += ring("grid", 0, [(0, 0), (50, 0), (50, 50), (0, 50)]) + ring("grid", 1, [(50, 50), (75, 50), (75, 75), (50, 75)])
    points = [(i, rnd.uniform(-40, 140), rnd.uniform(-40, 140)) for i in range(300)]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in (0, 25, 50, 75, 100) for y in (0, 25, 50, 75, 100))]
    return points, edges


@pytest.mark.parametrize(("most", "levels"), [(32, 6), (1, 3), (1, 6), (10_000, 1)])
def test_distances_equal_brute_force(spark, most, levels):
    points, edges = world(most + levels)
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r["id"], r["code"]): r["distance"] for r in geo.distances(df, spark.createDataFrame(edges, EDGES), "id", most, levels).collect()}
    assert len(got) == 4 * len(points)
    for i, x, y in points:
        for code in ("a", "b", "c", "grid"):
            assert got[i, code] == pytest.approx(plain(x, y, [e for e in edges if e[0] == code]), abs=1e-9), (i, x, y, code)


def test_points_look_at_few_edges(spark):
    rnd = random.Random(2)
    edges = ring("coast", 0, star(rnd, 0, 0, 100, 20_000))
    cells = spark.range(5000).select(*((F.rand(s) * 4096).cast("long").alias(c) for s, c in ((1, "ix"), (2, "iy"))))
    leaves = geo.cover(spark.createDataFrame(edges, EDGES), cells, geo.Grid(-110.0, -110.0, 220.0))
    most, mean = leaves.select(F.size("edges").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert most <= 200 and mean < 32


def test_plan_and_odd_points(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 9.0, 1.0)], "id int, x double, y double")
    square = spark.createDataFrame(ring("a", 0, [(0, 0), (2, 0), (2, 2), (0, 2)]), EDGES)
    for most in (1, 32):
        found = geo.distances(points, square, "id", most, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert {r["id"]: r["distance"] for r in found.collect()} == {1: 0.0, 2: None, 3: None, 4: 7.0}
    assert geo.distances(points.limit(0), spark.createDataFrame([], EDGES), "id").collect() == []
    assert geo.distances(points, spark.createDataFrame([], EDGES), "id").collect() == []
