"""Street data read off the driver's business tables, and the same as SQL text for the oracles.

Orders are ways of their customer's street, parts are nodes with coordinates by integer
arithmetic, regions and nations are rectangles. A second overlay draws short lines in a plane
of about ten kilometres, for everything that measures distances between lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.functions.names import normalize_name

TYPES = ("Via ", "Viale - Avenue ", "PIAZZA ", "")
STRIP = 2.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_lon(node):
    return F.lit(7.0) + (node * 7919) % 10007 / 1000.0


def node_lat(node):
    return F.lit(37.0) + (node * 104729) % 10009 / 1000.0


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, v): parts of each order in line order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("v"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = _vertices(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderkey").alias("way_id"), F.concat(kind, "c_name").alias("name"), F.col("v").alias("node_ids"))
    coord = F.transform("node_ids", lambda n: F.struct(n.alias("node_id"), node_lon(n).alias("lon"), node_lat(n).alias("lat")))
    return rows.select("way_id", "name", normalize_name(F.col("name")).alias("norm_name"), "node_ids", coord.alias("coords"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = _vertices(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    x = lambda o, n: ((o * 7919) % 199 * 50 + (n * 31) % 101).cast("double")
    y = lambda o, n: ((o * 104729) % 211 * 50 + (n * 17) % 103).cast("double")
    o = F.col("o_orderkey")
    coord = F.transform("v", lambda n: F.struct(n.alias("node_id"), x(o, n).alias("lon"), y(o, n).alias("lat")))
    group = F.concat(F.lit("g"), (F.col("o_custkey") % 100).cast("string"))
    # Nodes are numbered per order here, so that only distances join.
    return rows.select(o.alias("way_id"), group.alias("name"), group.alias("norm_name"), F.array(o).alias("node_ids"), coord.alias("coords"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions 0-3 as strips (level 4) and nations 0-23 as tiles (level 8); the rest is open country."""
    def box(col, row, height):
        x0, y0 = F.lit(7.0005) + col * STRIP, F.lit(37.0005) + row * STRIP
        p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        x1, y1 = x0 + STRIP, y0 + height
        return F.array(F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)))).cast(geo.POLYGONS)

    text = lambda c: F.col(c).cast("string")
    regions = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("long").alias("area_seq"), (F.col("r_regionkey") + 100).cast("long").alias("osm_id"), F.lit("4").alias("admin_level"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("istat"), box(F.col("r_regionkey"), F.lit(0), 5 * STRIP).alias("geometry"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 24").select((F.col("n_nationkey") + 10).cast("long").alias("area_seq"), (F.col("n_nationkey") + 1000).cast("long").alias("osm_id"), F.lit("8").alias("admin_level"), F.col("n_name").alias("name"), text("n_nationkey").alias("istat"), box(F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5), STRIP).alias("geometry"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return regions.union(nations).select("area_seq", "osm_id", F.lit(False).alias("from_way"), "admin_level", "name", none("postal_code"), "istat", none("catasto"), none("wikidata"), "geometry")


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    return s.select(n.alias("osm_id"), F.concat(F.lit("Piazza "), "s_name").alias("name"), node_lon(n).alias("lon"), node_lat(n).alias("lat"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names with diacritics: the whole text of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))


WAYS_SQL = """
v AS (SELECT l_orderkey AS way_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS node_ids FROM lineitem GROUP BY 1),
ways AS (SELECT way_id, CASE way_id % 4 WHEN 0 THEN 'Via ' WHEN 1 THEN 'Viale - Avenue ' WHEN 2 THEN 'PIAZZA ' ELSE '' END || c_name AS name,
                lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS norm_name, node_ids
         FROM v JOIN orders ON way_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

#: Streets by shared nodes: a way's component is the least way it reaches within its group.
STREETS_SQL = (
    WAYS_SQL
    + """,
atn AS (SELECT DISTINCT norm_name, way_id, unnest(node_ids) AS node FROM ways),
hub AS (SELECT norm_name, node, min(way_id) AS h FROM atn GROUP BY 1, 2),
e AS (SELECT DISTINCT way_id AS a, h AS b FROM atn JOIN hub USING (norm_name, node)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT way_id, way_id FROM ways UNION SELECT r.a, x.b FROM reach r JOIN e2 x ON r.b = x.a),
labelled AS (SELECT w.*, c AS component FROM ways w JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON way_id = a),
modes AS (SELECT norm_name, name FROM (SELECT norm_name, name, row_number() OVER (PARTITION BY norm_name ORDER BY count(*) DESC, name) AS r FROM ways GROUP BY 1, 2) WHERE r = 1),
streets AS (SELECT norm_name, m.name, list(way_id ORDER BY way_id) AS way_ids, component AS street_id FROM labelled JOIN modes m USING (norm_name) GROUP BY norm_name, m.name, component)"""
)

POINTS_SQL = (
    STREETS_SQL
    + """,
points AS (SELECT component AS street_id, norm_name, avg(7.0 + (n * 7919) % 10007 / 1000.0::DOUBLE) AS lon, avg(37.0 + (n * 104729) % 10009 / 1000.0::DOUBLE) AS lat
           FROM (SELECT component, norm_name, unnest(node_ids) AS n FROM labelled) GROUP BY 1, 2)"""
)

AREAS_SQL = f"""
areas AS (SELECT r_regionkey::BIGINT AS area_seq, r_regionkey + 100 AS osm_id, '4' AS admin_level, r_name AS name, 7.0005::DOUBLE + r_regionkey * {STRIP}::DOUBLE AS x0, 37.0005::DOUBLE AS y0, 5 * {STRIP}::DOUBLE AS h FROM region WHERE r_regionkey < 4
          UNION ALL SELECT n_nationkey + 10, n_nationkey + 1000, '8', n_name, 7.0005::DOUBLE + n_nationkey % 5 * {STRIP}::DOUBLE, 37.0005::DOUBLE + n_nationkey // 5 * {STRIP}::DOUBLE, {STRIP}::DOUBLE FROM nation WHERE n_nationkey < 24)"""
INSIDE = f"lon BETWEEN x0 AND x0 + {STRIP}::DOUBLE AND lat BETWEEN y0 AND y0 + h"

#: All pairs of ways of a group with the least distance of their segments (brute force).
LINES_SQL = """
v AS (SELECT l_orderkey AS way_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1),
l AS (SELECT way_id, 'g' || (o_custkey % 100) AS norm_name, p, len(p) AS n FROM v JOIN orders ON way_id = o_orderkey),
pt AS (SELECT way_id, norm_name, n, i, p[i] AS node, ((way_id * 7919) % 199 * 50 + (p[i] * 31) % 101)::DOUBLE AS x, ((way_id * 104729) % 211 * 50 + (p[i] * 17) % 103)::DOUBLE AS y FROM l, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
seg AS (SELECT a.way_id, a.norm_name, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM pt a JOIN pt b ON a.way_id = b.way_id AND b.i = a.i + 1),
near AS (SELECT s.norm_name, s.way_id AS a, t.way_id AS b, s.ax, s.ay, s.ex, s.ey, t.ax AS cx, t.ay AS cy, t.ex AS dx, t.ey AS dy FROM seg s JOIN seg t ON s.norm_name = t.norm_name AND s.way_id < t.way_id
         AND greatest(least(s.ax, s.ex) - greatest(t.ax, t.ex), least(t.ax, t.ex) - greatest(s.ax, s.ex)) <= 201 AND greatest(least(s.ay, s.ey) - greatest(t.ay, t.ey), least(t.ay, t.ey) - greatest(s.ay, s.ey)) <= 201),
foot AS (SELECT norm_name, a, b, CASE WHEN sign((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax)) * sign((ex - ax) * (dy - ay) - (ey - ay) * (dx - ax)) < 0
           AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (ey - cy) - (dy - cy) * (ex - cx)) < 0 THEN 0
         ELSE least(p2s(ax, ay, cx, cy, dx, dy), p2s(ex, ey, cx, cy, dx, dy), p2s(cx, cy, ax, ay, ex, ey), p2s(dx, dy, ax, ay, ex, ey)) END AS d2 FROM near),
gap AS (SELECT norm_name, a, b, sqrt(min(d2)) AS d FROM foot GROUP BY 1, 2, 3)"""


def _p2s(args: str) -> str:
    """Squared distance of a point from a segment, spelled out (the oracle has no macros)."""
    px, py, ax, ay, bx, by = args.split(", ")
    long2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"(CASE WHEN {long2} > 0 THEN greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {long2})) ELSE 0 END)"
    return f"(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


while "p2s(" in LINES_SQL:
    _at = LINES_SQL.index("p2s(")
    _to = LINES_SQL.index(")", _at)
    LINES_SQL = LINES_SQL[:_at] + _p2s(LINES_SQL[_at + 4 : _to]) + LINES_SQL[_to + 1 :]
