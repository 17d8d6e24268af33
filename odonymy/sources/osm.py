"""OpenStreetMap dumps: raw entities from XML or PBF, and the tables read off them.

Raw entities: nodes (node_id, lon, lat, tags), ways (way_id, refs, tags), relations
(relation_id, members of (type, ref, role), tags); tags are maps.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.functions.names import normalize_name
from odonymy.paths import is_file, name_of
from odonymy.session import ship

#: Compound suffixes before their endings, so that the longest one wins.
SUFFIXES = (".osm.pbf", ".osm.xml", ".osm.bz2", ".osm.gz", ".osm", ".pbf")
LEVELS = ("2", "4", "8")
#: Kinds of relations whose member ways form an area.
AREA_TYPES = ("multipolygon", "boundary")
_TAG = "tag array<struct<_k:string,_v:string>>"
_XML = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}",
}


class InputError(ValueError):
    """A dump that cannot be read."""


class MissingInput(InputError):
    pass


class UnsupportedFormat(InputError):
    pass


class Dump(NamedTuple):
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def detect_format(path: str) -> str | None:
    """The suffix that names the format, whatever its case; None for others."""
    name = name_of(path).lower()
    return next((s for s in SUFFIXES if name.endswith(s)), None)


def validate_input(path: str) -> str:
    """Format of an existing file, local or remote, or an error that says what is wrong."""
    if not is_file(path):
        raise MissingInput(f"no such file: {path}")
    found = detect_format(path)
    if found is None:
        raise UnsupportedFormat(f"{path}: not one of {', '.join(sorted(SUFFIXES))}")
    return found


def read(spark: SparkSession, path: str) -> Dump:
    """Raw entities of a dump; the format follows from the name."""
    kind = detect_format(path)
    if kind is None:
        raise UnsupportedFormat(f"{path}: not one of {', '.join(sorted(SUFFIXES))}")
    if kind.endswith("pbf"):
        from odonymy.sources.pbf import PbfSource

        ship(spark)
        spark.dataSource.register(PbfSource)
        return Dump(*(spark.read.format("osmpbf").option("entity", e).load(path) for e in ("node", "way", "relation")))
    xml = {e: spark.read.schema(s).option("rowTag", e).xml(path) for e, s in _XML.items()}
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.expr("cast(array() as array<struct<_k:string,_v:string>>)")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")
    return Dump(
        xml["node"].select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags),
        xml["way"].select(F.col("_id").alias("way_id"), F.transform(F.coalesce("nd", F.expr("cast(array() as array<struct<_ref:long>>)")), lambda n: n["_ref"]).alias("refs"), tags),
        xml["relation"].select(F.col("_id").alias("relation_id"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))).alias("members"), tags),
    )


def _located(ways: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Ways with coords: the located nodes of refs, in order. Nodes without a valid location stay out."""
    spot = nodes.where("lon between -180 and 180 and lat between -90 and 90").select("node_id", "lon", "lat")
    refs = ways.select(key, F.posexplode("refs").alias("pos", "node_id"))
    found = refs.join(spot, "node_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("c"))
    coords = F.transform("c", lambda c: F.struct(c["node_id"].alias("node_id"), c["lon"].alias("lon"), c["lat"].alias("lat")))
    return ways.join(found.select(key, coords.alias("coords")), key, "left")


def highways(nodes: DataFrame, ways: DataFrame, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Ways with a highway tag and two located nodes or more: way_id, name (null if untagged), norm_name, node_ids, coords.

    after, upto: only ways with ids over the one and not over the other (resuming); tested before any join.
    """
    kept = ways.where(F.col("tags")["highway"].isNotNull())
    if after is not None:
        kept = kept.where(F.col("way_id") > after)
    if upto is not None:
        kept = kept.where(F.col("way_id") <= upto)
    name = F.col("tags")["name"]
    rows = _located(kept.select("way_id", "refs", name.alias("name")), nodes, "way_id").where(F.size("coords") >= 2)
    return rows.select("way_id", "name", normalize_name(F.col("name")).alias("norm_name"), F.col("refs").alias("node_ids"), "coords")


def stitch(lines: list[list[tuple[int, float, float]]]) -> list[list[tuple[float, float]]] | None:
    """Closed rings from lines that share end nodes; None if a line stays open."""
    rest = [list(line) for line in lines if len(line) > 1]
    rings = []
    while rest:
        ring = rest.pop()
        while ring[0][0] != ring[-1][0]:
            for i, line in enumerate(rest):
                if line[0][0] == ring[-1][0]:
                    ring += line[1:]
                elif line[-1][0] == ring[-1][0]:
                    ring += line[-2::-1]
                else:
                    continue
                del rest[i]
                break
            else:
                return None
        if len(ring) < 4:
            return None
        rings.append([(x, y) for _, x, y in ring])
    return rings


def _inside(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def _size(ring: list[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))) / 2


def nest(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outer ring, then holes): a ring inside an odd number of others is a hole of the smallest."""
    rings = sorted((r for r in rings if _size(r) > 0), key=_size, reverse=True)
    # A point inside a small ring near its first edge decides; borders may touch.
    spot = lambda r: ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
    polygons: list[list] = []
    for i, ring in enumerate(rings):
        around = [j for j in range(i) if _inside(*spot(ring), rings[j])]
        if len(around) % 2 == 0:
            polygons.append([i, [ring]])
        else:
            next(p for p in reversed(polygons) if p[0] in around)[1].append(ring)
    return [p[1] for p in polygons]


_GEOMETRY = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _assemble(group: pa.Table) -> pa.Table:
    lines, complete = [], True
    for row in group.to_pylist():
        coords = row["coords"] or []
        complete &= len(coords) == row["n"]
        lines.append([(c["node_id"], c["lon"], c["lat"]) for c in coords])
    rings = stitch(lines) if complete else None
    polygons = nest(rings) if rings else []
    rows = [{"relation_id": group.column("relation_id")[0].as_py(), "geometry": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in polygons]}] if polygons else []
    return pa.Table.from_pylist(rows, pa.schema([("relation_id", pa.int64()), ("geometry", _GEOMETRY)]))


def assembled(dump: Dump, relations: DataFrame) -> DataFrame:
    """relation_id and geometry of relations whose member ways close; the others are left out."""
    ship(relations.sparkSession)
    members = relations.select("relation_id", F.explode("members").alias("m")).where("m.type = 'way'")
    members = members.select("relation_id", F.col("m.ref").alias("way_id"))
    used = dump.ways.join(members.select("way_id").distinct(), "way_id", "left_semi").select("way_id", "refs")
    lines = _located(used, dump.nodes, "way_id").select("way_id", "coords", F.size("refs").alias("n"))
    # A member that is not in the dump keeps the relation from closing, as its n is unknown.
    rows = members.join(lines, "way_id", "left").select("relation_id", "coords", F.coalesce("n", F.lit(-1)).alias("n"))
    return rows.groupBy("relation_id").applyInArrow(_assemble, f"relation_id long, geometry {geo.POLYGONS}")


def admin_areas(dump: Dump) -> DataFrame:
    """Administrative boundaries of LEVELS from relations, in id order (area_seq)."""
    tag = lambda k: F.col("tags")[k]
    kept = dump.relations.where((tag("boundary") == "administrative") & tag("admin_level").isin(*LEVELS) & tag("type").isin(*AREA_TYPES))
    rows = kept.join(assembled(dump, kept), "relation_id")
    names = {"admin_level": "admin_level", "name": "name", "postal_code": "postal_code", "istat": "ref:ISTAT", "catasto": "ref:catasto", "wikidata": "wikidata"}
    return rows.select(F.col("relation_id").alias("area_seq"), F.col("relation_id").alias("osm_id"), F.lit(False).alias("from_way"), *(tag(k).alias(c) for c, k in names.items()), "geometry")


def squares(dump: Dump) -> DataFrame:
    """Named place=square nodes, closed ways and multipolygon relations, each as one point: osm_id, name, lon, lat."""
    is_square = (F.col("tags")["place"] == "square") & F.col("tags")["name"].isNotNull()
    name = F.col("tags")["name"].alias("name")
    at_node = dump.nodes.where(is_square).where("lon between -180 and 180 and lat between -90 and 90").select(F.col("node_id").alias("osm_id"), name, "lon", "lat")
    closed = dump.ways.where(is_square & (F.size("refs") > 3) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1)))
    around = _located(closed, dump.nodes, "way_id").where(F.size("coords") == F.size("refs"))
    ring = F.transform("coords", lambda c: F.struct(c["lon"].alias("x"), c["lat"].alias("y")))
    by_way = around.select(F.col("way_id").alias("osm_id"), name, F.array(F.array(ring)).alias("geometry"))
    related = dump.relations.where(is_square & F.col("tags")["type"].isin(*AREA_TYPES))
    by_relation = related.join(assembled(dump, related), "relation_id").select(F.col("relation_id").alias("osm_id"), name, "geometry")
    inner = by_way.unionByName(by_relation).select("osm_id", "name", geo.inner_point(F.col("geometry")).alias("p")).where("p is not null")
    return at_node.unionByName(inner.select("osm_id", "name", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")))


