import math
import random

import pytest

from facetry.operators import cover

EDGE = "poly_id long, edge_id long, x1 double, y1 double, x2 double, y2 double"


def edges_of(polygons):
    return [(p, i, *map(float, a), *map(float, b)) for p, ring in polygons.items() for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]


def inside(x, y, ring):
    """Even-odd rule over a ring without jumps."""
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def star(rng, cx, cy, size, n):
    out = []
    for i in range(n):
        r = size * rng.uniform(0.3, 1)
        out.append((cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)))
    return out


@pytest.mark.parametrize("step", [0.7, 2.0, 11.0])
def test_points_equal_ray_casting(spark, step):
    rng = random.Random(int(step * 10))
    polygons = {1: star(rng, 0, 0, 20, 30), 2: star(rng, 9, 5, 6, 5), 3: [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)], 4: star(rng, -30, 40, 3, 200)}
    points = [(i, rng.uniform(-40, 30), rng.uniform(-30, 50)) for i in range(1500)]
    table = spark.createDataFrame(points, "cell long, lon double, lat double")
    got = {(r["cell"], r["poly_id"]) for r in cover.points_in_cover(table, cover.polygon_cover(spark.createDataFrame(edges_of(polygons), EDGE), step), step).collect()}
    assert got == {(i, p) for i, x, y in points for p, ring in polygons.items() if inside(x, y, ring)}


def test_polygon_over_the_antimeridian(spark):
    ring = [(170.0, -10.0), (-170.0, -12.0), (-165.0, 9.0), (172.0, 11.0)]
    flat = [(x + 360 if x < 0 else x, y) for x, y in ring]
    rng = random.Random(5)
    points = [(i, x - 360 if x > 180 else x, y) for i in range(600) for x, y in [(rng.uniform(160, 205), rng.uniform(-20, 20))]]
    edges = spark.createDataFrame(edges_of({7: ring}), EDGE)
    found = cover.points_in_cover(spark.createDataFrame(points, "cell long, lon double, lat double"), cover.polygon_cover(edges, 2.0), 2.0)
    assert {r["cell"] for r in found.collect()} == {i for i, x, y in points if inside(x + 360 if x < 0 else x, y, flat)}
    boxes = [(1, 0.0, 179.5, 2.0, 2.0), (2, 0.0, -179.5, 2.0, 2.0), (3, 0.0, -150.0, 2.0, 2.0), (4, 0.0, 169.0, 2.0, 4.0), (5, -11.0, -179.9, 2.0, 2.0)]
    table = spark.createDataFrame(boxes, "cell long, lat double, lon double, height double, width double")
    assert sorted(r["cell"] for r in cover.land_cells(table, edges, 2.0).collect()) == [1, 2, 4, 5]


def test_a_large_polygon_reads_few_edges(spark):
    """A ring of 20,000 edges: a point in an inner cell meets none, one in a border cell only that cell's."""
    n = 20_000
    ring = spark.range(n).selectExpr("1L AS poly_id", "id AS edge_id", *[f"{f}(2 * pi() * (id + {k}) / {n}) * 60 AS {a}{k + 1}" for k in (0, 1) for f, a in (("cos", "x"), ("sin", "y"))])
    border, inner = cover.polygon_cover(ring, 1.0)
    most = border.selectExpr("max(size(edges)) AS n").head()["n"]
    assert most < n / 100
    covered = inner.selectExpr("sum(high - low + 1) AS n").head()["n"]
    assert 0.9 * math.pi * 3600 < covered < math.pi * 3600
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 59.99, 0.0), (3, 60.01, 0.0), (4, 42.4, 42.4), (5, 42.5, 42.5)], "cell long, lon double, lat double")
    assert sorted(r["cell"] for r in cover.points_in_cover(points, (border, inner)).collect()) == [1, 2, 4]
