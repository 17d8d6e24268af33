"""Plane geometry as Column expressions: projection, segment distance, point in polygon."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


@dataclass(frozen=True)
class Identity:
    """Coordinates taken as metres already."""

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat


@dataclass(frozen=True)
class TransverseMercator:
    """Krueger series to the fourth order; the defaults are the registered Italian zone (EPSG 6875)."""

    meridian: float = 12.0
    scale: float = 0.9985
    false_east: float = 7_000_000.0
    false_north: float = 0.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257222101

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        f = self.flattening
        n, e = f / (2 - f), math.sqrt(f * (2 - f))
        radius = self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        series = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        phi, lam = F.radians(lat), F.radians(lon - self.meridian)
        sine = F.sin(phi)
        t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
        north = F.atan2(t, F.cos(lam))
        east = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
        y, x = north, east
        for j, a in enumerate(series, 1):
            y = y + a * F.sin(2 * j * north) * F.cosh(2 * j * east)
            x = x + a * F.cos(2 * j * north) * F.sinh(2 * j * east)
        return self.false_east + self.scale * radius * x, self.false_north + self.scale * radius * y


def osm_ref(from_way: Column, osm_id: Column) -> Column:
    return F.concat(F.when(from_way, "way/").otherwise("relation/"), osm_id.cast("string"))


def middle(coords: Column) -> Column:
    """The vertex half-way along the list; null for none."""
    return F.get(coords, F.floor(F.size(coords) / 2).cast("int"))


def finite(coords: Column) -> Column:
    """Whether all vertices have coordinates that are numbers."""
    return ~F.exists(coords, lambda c: F.isnan(c["lon"]) | F.isnan(c["lat"]) | (F.abs(c["lon"]) == float("inf")) | (F.abs(c["lat"]) == float("inf")) | c["lon"].isNull() | c["lat"].isNull())


def metric(coords: Column, projection: Identity | TransverseMercator) -> Column:
    """Vertices as (node_id, x, y); null with fewer than two, or if one cannot be measured."""

    def one(c: Column) -> Column:
        x, y = projection.xy(c["lon"], c["lat"])
        return F.struct(c["node_id"].alias("node_id"), x.alias("x"), y.alias("y"))

    return F.when((F.size(coords) >= 2) & finite(coords), F.transform(coords, one))


def segment_list(line: Column) -> Column:
    """Structs (pos, ax, ay, bx, by) of consecutive vertices."""
    return F.transform(F.slice(line, F.lit(1), F.size(line) - 1), lambda p, i: F.struct(i.alias("pos"), p["x"].alias("ax"), p["y"].alias("ay"), F.get(line, i + 1)["x"].alias("bx"), F.get(line, i + 1)["y"].alias("by")))


def segments(lines: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """A row for each pair of consecutive vertices: keep, pos, ax, ay, bx, by."""
    rows = lines.where(F.col(line).isNotNull() & (F.size(line) >= 2)).select(*keep, F.explode(segment_list(F.col(line))).alias("s"))
    return rows.select(*keep, "s.*")


def pieces(lines: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """Segments of ``line``, long ones in pieces of 4 sizes at most, with their box: keep, pos, ax, ay, bx, by, x0, x1, y0, y1.

    Thus none lists more than a few cells of that size; the least distance of the pieces is the segment's.
    """
    seg = segments(lines, "line", keep)
    n = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / (4 * size)).cast("double"))
    seg = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    along = lambda k, i: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * i / F.col("n")
    # Known to be there: without tests for null the distance of a pair is a short loop.
    cut = (F.coalesce(F.when(F.col("i") + o == F.col("n") * o, F.col(f"{e}{k}")).otherwise(along(k, F.col("i") + o)), F.lit(0.0)).alias(f"{e}{k}") for k in "xy" for e, o in (("a", 0), ("b", 1)))
    seg = seg.select(*keep, "pos", *cut)
    return seg.select("*", *(f(f"a{k}", f"b{k}").alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.least, F.greatest))))


def _foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """(squared distance, x, y) of the point on a-b next to p; a-b may be a point."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long2))).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    return (px - x) * (px - x) + (py - y) * (py - y), x, y


def directed(segment: Column) -> Column:
    """A segment struct (ax, ay, bx, by) with what ``distance2`` needs besides: dx, dy and inv, 1 / length^2 (0 for a point)."""
    dx, dy = segment["bx"] - segment["ax"], segment["by"] - segment["ay"]
    inv = F.coalesce(F.try_divide(F.lit(1.0), dx * dx + dy * dy), F.lit(0.0))
    return segment.withField("dx", dx).withField("dy", dy).withField("inv", inv)


def crossing(s: str, t: str) -> Column:
    """Whether directed segments s and t cross inside both (touching ends have distance 0 anyway)."""

    def apart(p: str, q: str) -> Column:
        """Whether q's ends lie strictly on different sides of p's line."""
        side = lambda k: F.col(f"{p}.dx") * (F.col(f"{q}.{k}y") - F.col(f"{p}.ay")) - F.col(f"{p}.dy") * (F.col(f"{q}.{k}x") - F.col(f"{p}.ax"))
        return side("a") * side("b") < 0

    return apart(s, t) & apart(t, s)


def nearest(s: str, t: str) -> Column:
    """Struct (sx, sy, tx, ty): where two segments (ax, ay, bx, by) that do not cross are nearest.

    One of the four ends is nearest; of equally near ones (to a millionth) the least coordinates.
    Meant for the winning pairs only: ``distance2`` is the formula for all pairs.
    """
    c = lambda a, k: F.col(f"{a}.{k}")
    ends = []
    for p, q in ((s, t), (t, s)):
        for k in ("a", "b"):
            here = (c(p, f"{k}x"), c(p, f"{k}y"))
            d2, *there = _foot(*here, c(q, "ax"), c(q, "ay"), c(q, "bx"), c(q, "by"))
            (sx, sy), (tx, ty) = (here, there) if p == s else (there, here)
            ends.append(F.struct(F.round(d2, 6).alias("d2"), *(F.round(v, 6).alias(n) for v, n in ((sx, "sx"), (sy, "sy"), (tx, "tx"), (ty, "ty")))))
    return F.array_min(F.array(*ends)).dropFields("d2")


def distance2(s: str, t: str) -> Column:
    """Squared distance of two directed segments; little and plain arithmetic, so it stays in one compiled loop."""

    def foot(p: str, k: str, q: str) -> Column:
        u, v = F.col(f"{p}.{k}x") - F.col(f"{q}.ax"), F.col(f"{p}.{k}y") - F.col(f"{q}.ay")
        dx, dy, inv = (F.col(f"{q}.{n}") for n in ("dx", "dy", "inv"))
        along, aside = (u * dx + v * dy) * inv, u * dy - v * dx
        return F.when(along <= 0, u * u + v * v).when(along >= 1, (u - dx) * (u - dx) + (v - dy) * (v - dy)).otherwise(aside * aside * inv)

    return F.when(crossing(s, t), 0.0).otherwise(F.least(*(foot(p, k, q) for p, q in ((s, t), (t, s)) for k in "ab")))


def project_geometry(geometry: Column, projection: Identity | TransverseMercator) -> Column:
    """Every vertex of a multipolygon (lon and lat as x and y) in the plane."""

    def place(p: Column) -> Column:
        x, y = projection.xy(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, place)))


def edge_list(geometry: Column) -> Column:
    """Structs (ax, ay, bx, by) of all sides of all rings; open rings are closed."""

    def edges(ring: Column) -> Column:
        return F.transform(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, i + 1)["x"].alias("bx"), F.get(ring, i + 1)["y"].alias("by")))

    every = F.transform(F.flatten(geometry), lambda r: edges(F.when(r[0] == F.get(r, F.size(r) - 1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))))
    return F.flatten(every)


def edges_for(edges: Column, x0: Column, y0: Column, y1: Column) -> Column:
    """The sides that can matter to points right of x0 between y0 and y1: ``covered`` says the same with them as with all."""
    return F.filter(edges, lambda e: (F.greatest(e["ay"], e["by"]) >= y0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ax"], e["bx"]) >= x0))


def covers(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a multipolygon (polygons of rings, holes included) covers a point; borders belong to it."""
    return covered(edge_list(geometry), x, y)


def covered(every: Column, x: Column, y: Column) -> Column:
    """The same from the multipolygon's sides: even-odd rule over all rings, or the point on any ring's line."""
    crosses = F.filter(every, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    touches = F.exists(every, lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    return touches | (F.size(crosses) % 2 == 1)


def bounds(geometry: Column) -> Column:
    """Struct (x0, y0, x1, y1) around a multipolygon."""
    points = F.flatten(F.flatten(geometry))
    each = lambda k: F.transform(points, lambda p: p[k])
    return F.struct(F.array_min(each("x")).alias("x0"), F.array_min(each("y")).alias("y0"), F.array_max(each("x")).alias("x1"), F.array_max(each("y")).alias("y1"))


def inner_point(geometry: Column) -> Column:
    """A point (x, y) inside a multipolygon: the middle of the widest stretch on a line at mid height.

    The line lies half-way between two neighbouring vertex heights around the middle, so it meets no vertex.
    """
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(F.flatten(geometry)), lambda p: p["y"])))
    k = F.floor((F.size(heights) - 2) / 2).cast("int")
    level = (F.get(heights, k) + F.get(heights, k + 1)) / 2

    def cuts(ring: Column) -> Column:
        n = F.size(ring)
        at = lambda i: F.get(ring, i % n)
        hit = F.transform(ring, lambda p, i: F.when((p["y"] > level) != (at(i + 1)["y"] > level), p["x"] + (level - p["y"]) * (at(i + 1)["x"] - p["x"]) / (at(i + 1)["y"] - p["y"])))
        return F.filter(hit, lambda v: v.isNotNull())

    xs = F.array_sort(F.flatten(F.transform(F.flatten(geometry), cuts)))
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda i: i >= 0), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("w"), ((F.get(xs, i + 1) + F.get(xs, i)) / 2).alias("x")))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(spans)["x"].alias("x"), level.alias("y")))
