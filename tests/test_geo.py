import math
import random

import pytest
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.operators import cities


def polygon(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]


@pytest.fixture(scope="module")
def covered(spark):
    def run(shape, points):
        rows = spark.createDataFrame([(i, shape, float(x), float(y)) for i, (x, y) in enumerate(points)], f"i int, g {geo.POLYGONS}, x double, y double")
        return [r.c for r in rows.select("i", geo.covers(F.col("g"), F.col("x"), F.col("y")).alias("c")).orderBy("i").collect()]

    return run


def test_polygon_covers_inside_edge_and_vertex(covered):
    assert covered(polygon(SQUARE), [(5, 5), (0, 5), (10, 10), (11, 5), (-0.1, 0)]) == [True, True, True, False, False]


def test_holes_are_outside_but_their_edges_are_not(covered):
    assert covered(polygon(SQUARE, HOLE), [(5, 5), (4, 5), (3, 3)]) == [False, True, True]


def test_multipolygon_and_open_ring(covered):
    two = polygon(SQUARE) + polygon([(20, 20), (21, 20), (21, 21), (20, 21)])
    assert covered(two, [(20.5, 20.5), (20, 20.5), (15, 15)]) == [True, True, False]


def test_inner_point_lies_inside(spark):
    shapes = [polygon(SQUARE), polygon(SQUARE, HOLE), polygon([(0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10), (0, 0)]), polygon([(0, 0), (4, 0), (2, 3), (0, 0)])]
    rows = spark.createDataFrame([(s,) for s in shapes], f"g {geo.POLYGONS}")
    rows = rows.withColumn("p", geo.inner_point(F.col("g")))
    assert rows.where(geo.covers(F.col("g"), F.col("p.x"), F.col("p.y"))).count() == len(shapes)


def gap(s, t):
    """Distance of two segments by plain Python."""

    def foot(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        u = 0 if n == 0 else max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n))
        return math.dist(p, (a[0] + u * d[0], a[1] + u * d[1]))

    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if turn(*s, t[0]) * turn(*s, t[1]) < 0 and turn(*t, s[0]) * turn(*t, s[1]) < 0:
        return 0.0
    return min(foot(s[0], *t), foot(s[1], *t), foot(t[0], *s), foot(t[1], *s))


def test_segment_distance_equals_plain_python(spark):
    rng = random.Random(2)
    point = lambda: (float(rng.randint(0, 6)), float(rng.randint(0, 6)))
    pairs = [((point(), point()), (point(), point())) for _ in range(400)]
    flat = [(i, dict(zip(("ax", "ay", "bx", "by"), s[0] + s[1], strict=True)), dict(zip(("ax", "ay", "bx", "by"), t[0] + t[1], strict=True))) for i, (s, t) in enumerate(pairs)]
    kind = "struct<ax:double,ay:double,bx:double,by:double>"
    rows = spark.createDataFrame(flat, f"i int, s {kind}, t {kind}").select("i", *(geo.directed(F.col(c)).alias(c) for c in "st")).select("i", F.sqrt(geo.distance2("s", "t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == pytest.approx([gap(*p) for p in pairs], abs=1e-9)


def test_projection_keeps_known_distances(spark):
    places = [(7.3, 45.0), (7.3, 46.0), (12.0, 42.0), (7.0, 45.0), (7.0009, 45.0)]
    x, y = geo.TransverseMercator().xy(F.col("lon"), F.col("lat"))
    at = [(r.x, r.y) for r in spark.createDataFrame(places, "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()]
    assert math.dist(at[0], at[1]) / 2000 == pytest.approx(55.58, abs=0.2)
    assert at[2][0] == pytest.approx(7_000_000)
    assert math.dist(at[3], at[4]) == pytest.approx(71, abs=1)


def test_middle_vertex(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([],)], "c array<int>")
    assert [r[0] for r in rows.select(geo.middle(F.col("c"))).collect()] == [2, 2, None]


def test_clipped_outlines_cover_the_same_points(spark):
    """Random rings (crossing themselves, with holes, open) and points on and off their lines: cell by cell as with all sides."""
    rng = random.Random(5)
    spot = lambda: {"x": float(rng.randint(0, 12)), "y": float(rng.randint(0, 12))}
    ring = lambda: [spot() for _ in range(rng.randint(3, 9))]
    shapes = []
    for i in range(30):
        rings = [ring() for _ in range(rng.randint(1, 3))]
        shapes.append((i, [[r + r[:1] if rng.random() < 0.7 else r for r in rings]]))
    areas = spark.createDataFrame(shapes, f"area_seq long, geometry {geo.POLYGONS}")
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(-2, 27) for y in range(-2, 27)], "lon double, lat double")
    want = {(r.area_seq, r.lon, r.lat) for r in points.crossJoin(areas).where(geo.covers(F.col("geometry"), F.col("lon"), F.col("lat"))).collect()}
    for cell in (0.7, 2.5, 100.0):
        got = cities._hits(points, areas, cell).select("area_seq", "lon", "lat").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_project_geometry_keeps_the_shape(spark):
    shape = [[[{"x": 12.0, "y": 42.0}, {"x": 12.1, "y": 42.0}, {"x": 12.0, "y": 42.1}, {"x": 12.0, "y": 42.0}]]]
    row = spark.createDataFrame([(shape,)], f"g {geo.POLYGONS}").select(geo.project_geometry(F.col("g"), geo.TransverseMercator()).alias("p")).first()
    assert [len(r) for p in row.p for r in p] == [4] and row.p[0][0][0].x == pytest.approx(7_000_000)
