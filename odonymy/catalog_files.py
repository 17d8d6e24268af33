"""Queries over what is written and read again: dumps, the store, streams, resumed runs, text files; and over the order of results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odonymy import catalog as c
from odonymy import sinks
from odonymy.catalog import query
from odonymy.functions import geo
from odonymy.functions.names import normalize_name
from odonymy.operators import aliases, cities, points, stats, streets
from odonymy.paths import write_text
from odonymy.plans import overlay as o
from odonymy.session import discard, scratch_path, ship
from odonymy.sources import config_files, osm
from odonymy.store import Store
from odonymy.streaming import ingest

# ---- a dump: parts are nodes, orders ways, suppliers square nodes, nations closed ways and boundary relations
_LEVEL = "CASE n_nationkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN '8' ELSE '6' END"
_BOX_SQL = f"box AS (SELECT *, 7.0005::DOUBLE + n_nationkey % 5 * {o.STRIP}::DOUBLE AS x0, 37.0005::DOUBLE + n_nationkey // 5 * {o.STRIP}::DOUBLE AS y0 FROM nation)"
_DUMP_WAYS_SQL = """
v AS (SELECT l_orderkey AS way_id, count(*)::BIGINT AS refs, count_if(l_partkey % 97 <> 0)::BIGINT AS located FROM lineitem GROUP BY 1),
dump AS (SELECT way_id, CASE WHEN way_id % 9 <> 0 THEN CASE way_id % 4 WHEN 0 THEN 'Via ' WHEN 1 THEN 'Viale - Avenue ' WHEN 2 THEN 'PIAZZA ' ELSE '' END || c_name END AS name,
                CASE WHEN way_id % 9 <> 0 THEN lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) END AS norm_name, refs, located
         FROM v JOIN orders ON way_id = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE way_id % 10 <> 0 AND located >= 2)"""


def _tag(key: str, value: Column | str) -> Column:
    return F.concat(F.lit(f'<tag k="{key}" v="'), value if isinstance(value, Column) else F.lit(value), F.lit('"/>'))


def _node(number: Column, lon: Column, lat: Column, tags: Column | None = None) -> Column:
    return F.concat(F.lit('<node id="'), number.cast("string"), F.lit('" lon="'), lon.cast("string"), F.lit('" lat="'), lat.cast("string"), F.lit('">'), F.lit("") if tags is None else tags, F.lit("</node>"))


def _way(number: Column, refs: Column, tags: Column) -> Column:
    listed = F.array_join(F.transform(refs, lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    return F.concat(F.lit('<way id="'), number.cast("string"), F.lit('">'), listed, tags, F.lit("</way>"))


def _dump(spark: SparkSession, sf_dir: str) -> osm.Dump:
    """Writes an XML dump in pieces to the shared folder and reads it as a dump."""
    n = F.col("p_partkey")
    nodes = o.table(spark, sf_dir, "part").select(_node(n, o.node_lon(n), F.when(n % 97 == 0, 95.0).otherwise(o.node_lat(n))))
    s = F.col("s_suppkey")
    spots = o.table(spark, sf_dir, "supplier").select(_node(s + 10_000_000, o.node_lon(s), o.node_lat(s), F.concat(_tag("place", "square"), F.when(s % 5 != 0, _tag("name", F.col("s_name"))).otherwise(""))))
    k = F.col("n_nationkey")
    x0, y0 = 7.0005 + k % 5 * F.lit(o.STRIP), 37.0005 + F.floor(k / 5) * F.lit(o.STRIP)
    nation = o.table(spark, sf_dir, "nation")
    corners = nation.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y"), k.alias("k")) for i, (x, y) in enumerate(((x0, y0), (x0 + o.STRIP, y0), (x0 + o.STRIP, y0 + o.STRIP), (x0, y0 + o.STRIP)))))).alias("p"))
    corners = corners.select(_node(20_000_000 + F.col("p.k") * 4 + F.col("p.i"), F.col("p.x"), F.col("p.y")))
    ring = F.transform(F.array(*map(F.lit, (0, 1, 2, 3, 0))), lambda i: 20_000_000 + k * 4 + i)
    rings = nation.select(_way(30_000_000 + k, ring, F.when(k % 4 == 0, F.concat(_tag("place", "square"), _tag("name", F.col("n_name")))).otherwise("")))
    level = F.element_at(F.array(*map(F.lit, "2486")), (k % 4 + 1).cast("int"))
    tags = F.concat(_tag("boundary", "administrative"), _tag("admin_level", level), _tag("name", F.col("n_name")), _tag("type", F.when(k == 5, "collection").otherwise("boundary")))
    relations = nation.select(F.concat(F.lit('<relation id="'), (40_000_000 + k).cast("string"), F.lit('"><member type="way" ref="'), (30_000_000 + k).cast("string"), F.lit('" role="outer"/>'), tags, F.lit("</relation>")))
    w = F.col("way_id")
    named = F.when(w % 9 != 0, _tag("name", F.col("name"))).otherwise("")
    ways = o.ways(spark, sf_dir).select(_way(w, F.col("node_ids"), F.concat(F.when(w % 10 != 0, _tag("highway", "residential")).otherwise(""), named)))
    path = scratch_path(spark, "dump") + ".osm"
    every = nodes.union(spots).union(corners).union(rings).union(relations).union(ways)
    ship(spark)
    every.toDF("value").mapInArrow(_rooted, "value string").write.text(path)
    return osm.read(spark, path)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Makes each piece a document of its own."""
    yield pa.record_batch({"value": ["<osm>"]})
    yield from batches
    yield pa.record_batch({"value": ["</osm>"]})


@query(f"WITH {_DUMP_WAYS_SQL} SELECT way_id, name, norm_name, refs, located FROM dump")
def dump_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    dump = _dump(spark, sf_dir)
    return osm.highways(dump.nodes, dump.ways).select("way_id", "name", "norm_name", F.size("node_ids").cast("long").alias("refs"), F.size("coords").cast("long").alias("located"))


@query(f"""WITH {_BOX_SQL} SELECT s_suppkey + 10000000 AS osm_id, s_name AS name, round(7.0 + (s_suppkey * 7919) % 10007 / 1000.0::DOUBLE, 9) AS lon, round(37.0 + (s_suppkey * 104729) % 10009 / 1000.0::DOUBLE, 9) AS lat FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 30000000 + n_nationkey, n_name, round(x0 + {o.STRIP / 2}, 9), round(y0 + {o.STRIP / 2}, 9) FROM box WHERE n_nationkey % 4 = 0""")
def dump_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.squares(_dump(spark, sf_dir)).select("osm_id", "name", c._r("lon", 9), c._r("lat", 9))


@query(f"WITH {_BOX_SQL} SELECT (40000000 + n_nationkey)::BIGINT AS osm_id, {_LEVEL} AS admin_level, n_name AS name, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x0 + {o.STRIP}, 6) AS x1, round(y0 + {o.STRIP}, 6) AS y1 FROM box WHERE n_nationkey % 4 <> 3 AND n_nationkey <> 5")
def dump_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geo.bounds(F.col("geometry"))
    return osm.admin_areas(_dump(spark, sf_dir)).select("osm_id", "admin_level", "name", *(F.round(box[k], 6).alias(k) for k in ("x0", "y0", "x1", "y1")))


@query(f"WITH {_DUMP_WAYS_SQL} SELECT way_id, name, norm_name, (SELECT count(*) FROM dump)::BIGINT AS parsed, (SELECT count(*) FROM dump WHERE name IS NULL)::BIGINT AS unnamed, 0::BIGINT AS cursors FROM dump WHERE name IS NOT NULL")
def resumed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction that was stopped after its first step and is started again."""
    dump, store = _dump(spark, sf_dir), Store(spark, scratch_path(spark, "resumed"))
    middle = dump.ways.where("way_id < 30000000").agg(F.percentile_approx("way_id", 0.4)).first()[0]
    osm.highways(dump.nodes, dump.ways, None, middle).write.parquet(f"{store.path}/ways_parts/{middle}")
    ingest.extract_in_steps(store, dump.nodes, dump.ways, 2)
    numbers = (F.lit(v).cast("long").alias(k) for k, v in (("parsed", store.meta("parsed_count")), ("unnamed", store.meta("unnamed_count")), ("cursors", len(store.parts("ways_parts")))))
    return store.read("ways").select("way_id", "name", "norm_name", *numbers)


# ---- the store, streams and resumed joins
_NEW_SQL = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@query(f"WITH {o.WAYS_SQL} SELECT way_id, CASE WHEN way_id % 5 = 0 THEN 'Nuova ' || name ELSE name END AS name, CASE WHEN way_id % 5 = 0 THEN {_NEW_SQL.format(chr(39) + 'Nuova ' + chr(39) + ' || name')} ELSE norm_name END AS norm_name, len(node_ids)::BIGINT AS nodes FROM ways")
def stored_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways in the store after an upsert whose batch has two versions of each changed row: the later one holds."""
    store = Store(spark, scratch_path(spark, "stored"))
    store.write("ways", o.ways(spark, sf_dir))
    changed = store.read("ways").where("way_id % 5 = 0")
    versions = [changed.withColumn("name", F.concat(F.lit(word), "name")).withColumn("at", F.lit(i)) for i, word in enumerate(("Zeta ", "Nuova "))]
    batch = versions[0].unionByName(versions[1]).withColumn("norm_name", normalize_name(F.col("name")))
    ingest.upsert(store, batch, order=F.col("at"))
    return store.read("ways").select("way_id", "name", "norm_name", F.size("node_ids").cast("long").alias("nodes"))


@query("""SELECT 'areas' AS name, (SELECT count(*) FROM region WHERE r_regionkey < 4) + (SELECT count(*) FROM nation WHERE n_nationkey < 24) AS rows, (SELECT sum(r_regionkey) FROM region WHERE r_regionkey < 4)::BIGINT + (SELECT sum(n_nationkey + 10) FROM nation WHERE n_nationkey < 24)::BIGINT AS ids
UNION ALL SELECT 'squares', count(*), sum(s_suppkey)::BIGINT FROM supplier UNION ALL SELECT 'meta', 2, 12 UNION ALL SELECT 'streets', 0, 0""")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, squares and numbers written twice (the second version holds), and a table that was cleared."""
    store = Store(spark, scratch_path(spark, "tables"))
    for _ in range(2):
        store.write("areas", o.areas(spark, sf_dir))
        store.write("squares", o.squares(spark, sf_dir))
    store.set_meta(a=4, b=7, gone=3)
    store.set_meta(a=5, gone=None)
    store.write("streets", spark.createDataFrame([("k", "n", [1], 1)], "norm_name string, name string, way_ids array<long>, street_id long"))
    store.clear("streets")
    one = lambda name, of: store.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(of), F.lit(0)).cast("long").alias("ids"))
    return one("areas", "area_seq").union(one("squares", "osm_id")).union(one("meta", "value")).union(one("streets", "street_id"))


@query(f"""WITH {o.WAYS_SQL}, n AS (SELECT way_id, CASE WHEN way_id % 9 <> 0 THEN name END AS old, CASE WHEN way_id % 7 = 0 THEN 'Corso ' || name END AS new FROM ways)
SELECT way_id, coalesce(new, old) AS name, (SELECT count(*) + count(new) FROM n)::BIGINT AS parsed, (SELECT count_if(old IS NULL) FROM n)::BIGINT AS unnamed FROM n WHERE coalesce(new, old) IS NOT NULL""")
def streamed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken in by a stream that is started twice; the second start has rows that replace earlier ones."""
    store, source, mark = Store(spark, scratch_path(spark, "streamed")), scratch_path(spark, "incoming"), scratch_path(spark, "checkpoint")
    raw = o.ways(spark, sf_dir).select("way_id", F.when(F.col("way_id") % 9 != 0, F.col("name")).alias("name"), "node_ids", "coords", F.col("name").alias("whole"))
    raw.drop("whole").coalesce(2).write.parquet(source)
    ingest.follow_ways(spark, source, store, mark)
    raw.where("way_id % 7 = 0").withColumn("name", F.concat(F.lit("Corso "), "whole")).drop("whole").coalesce(1).write.mode("append").parquet(source)
    ingest.follow_ways(spark, source, store, mark)
    ingest.follow_ways(spark, source, store, mark)  # nothing new
    return store.read("ways").select("way_id", "name", *(F.lit(store.meta(f"{k}_count")).cast("long").alias(k) for k in ("parsed", "unnamed")))


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT norm_name, name, array_to_string(way_ids, ',') AS way_ids, street_id, count(*) OVER (PARTITION BY norm_name)::BIGINT AS count, 0::BIGINT AS parts FROM streets")
def resumed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join in four buckets of which one was done before."""
    store = Store(spark, scratch_path(spark, "joined"))
    store.write("ways", o.ways(spark, sf_dir))
    first = store.read("ways").where(F.pmod(F.xxhash64("norm_name"), F.lit(4)) == 1)
    streets.streets(streets.components(first)).write.parquet(f"{store.path}/streets_parts/of=4/bucket=1")
    ingest.join_in_buckets(store, None, buckets=4)
    found = store.read("streets").join(store.read("street_groups").select("norm_name", "count"), "norm_name")
    return found.select("norm_name", "name", F.array_join(F.transform("way_ids", lambda w: w.cast("string")), ",").alias("way_ids"), "street_id", "count", F.lit(len(store.parts("streets_parts/of=4"))).cast("long").alias("parts"))


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT street_id, len(list_distinct(way_ids))::BIGINT AS ways, '[' || array_to_string(way_ids, ',') || ']' AS json, list_sum(way_ids)::BIGINT AS total FROM streets")
def json_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = c._streets(spark, sf_dir).select("street_id", streets.street_count(F.col("way_ids")).alias("ways"), streets.ids_to_json(F.col("way_ids")).alias("json"))
    return made.withColumn("total", F.aggregate(streets.ids_from_json(F.col("json")), F.lit(0).cast("long"), lambda a, x: a + x))


# ---- both rules, near misses in full
@query(f"""WITH RECURSIVE {o.LINES_SQL}, shared AS (SELECT way_id, norm_name, way_id // 128 AS node FROM l),
hub AS (SELECT norm_name, node, min(way_id) AS h FROM shared GROUP BY 1, 2),
one AS (SELECT a, b FROM gap WHERE d <= {c.THRESHOLD} UNION SELECT h, way_id FROM shared JOIN hub USING (norm_name, node) WHERE h <> way_id),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(a, b) AS (SELECT way_id, way_id FROM l UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS way_id, min(b) AS component FROM reach GROUP BY a""")
def mixed_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways joined by shared nodes and by distance together."""
    lines = c._stored_lines(spark, sf_dir).withColumn("node_ids", F.array(F.floor(F.col("way_id") / 128).cast("long")))
    return streets.components(lines, c.THRESHOLD, geo.Identity()).select("way_id", "component")


def _foot(p: str, a: str, b: str) -> tuple[str, str, str]:
    """Squared distance of point p from segment a-b and the foot's coordinates, in SQL; points are (x, y) columns."""
    (px, py), (ax, ay), (bx, by) = ((f"{q}x", f"{q}y") for q in (p, a, b))
    long2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"(CASE WHEN {long2} > 0 THEN greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {long2})) ELSE 0 END)"
    x, y = f"({ax} + {t} * ({bx} - {ax}))", f"({ay} + {t} * ({by} - {ay}))"
    return f"(pow({px} - {x}, 2) + pow({py} - {y}, 2))", x, y


def _ends_sql() -> str:
    out = []
    for p, q in ((("s.a", "s.b"), ("t.a", "t.b")), (("t.a", "t.b"), ("s.a", "s.b"))):
        for end in p:
            d2, x, y = _foot(end, *q)
            here, there = f"round({end}x, 6), round({end}y, 6)", f"round({x}, 6), round({y}, 6)"
            out.append(f"row(round({d2}, 6), {f'{here}, {there}' if end[0] == 's' else f'{there}, {here}'})")
    return ", ".join(out)


_NEAR_SQL = f"""{o.LINES_SQL}, e AS (SELECT a, b FROM gap WHERE d <= {c.THRESHOLD} UNION SELECT b, a FROM gap WHERE d <= {c.THRESHOLD}),
reach(a, b) AS (SELECT way_id, way_id FROM l UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS way_id, min(b) AS component FROM reach GROUP BY a),
st AS (SELECT component, min(way_id) AS street_id FROM comp JOIN l USING (way_id) WHERE n >= 2 GROUP BY 1),
ws AS (SELECT way_id, street_id FROM comp JOIN st USING (component)),
p AS (SELECT norm_name, least(x.street_id, y.street_id) AS sa, greatest(x.street_id, y.street_id) AS sb, d, CASE WHEN x.street_id > y.street_id THEN row(round(d * d, 6), b, a) ELSE row(round(d * d, 6), a, b) END AS m FROM gap JOIN ws x ON x.way_id = a JOIN ws y ON y.way_id = b WHERE x.street_id <> y.street_id),
best AS (SELECT norm_name, sa AS street_id_a, sb AS street_id_b, min(d) AS distance_m, min(m) AS m FROM p GROUP BY 1, 2, 3 HAVING min(d) >= {c.THRESHOLD} AND min(d) < 2 * {c.THRESHOLD}),
near_pairs AS (SELECT *, m[2] AS way_id_a, m[3] AS way_id_b FROM best),
sg AS (SELECT u.way_id, u.x AS ax, u.y AS ay, w.x AS bx, w.y AS by FROM pt u JOIN pt w ON u.way_id = w.way_id AND w.i = u.i + 1),
at_gap AS (SELECT way_id_a, way_id_b, min(list_min([{_ends_sql()}])) AS g FROM (SELECT DISTINCT way_id_a, way_id_b FROM near_pairs) JOIN sg s ON s.way_id = way_id_a JOIN sg t ON t.way_id = way_id_b GROUP BY 1, 2),
na AS (SELECT way_id_a, way_id_b, min(row(round(pow(x - g[2], 2) + pow(y - g[3], 2), 6), node))[2] AS node_id_a FROM at_gap JOIN pt ON way_id = way_id_a GROUP BY 1, 2),
nb AS (SELECT way_id_a, way_id_b, min(row(round(pow(x - g[4], 2) + pow(y - g[5], 2), 6), node))[2] AS node_id_b FROM at_gap JOIN pt ON way_id = way_id_b GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_NEAR_SQL} SELECT norm_name AS name, norm_name, street_id_a, street_id_b, way_id_a, way_id_b, node_id_a, node_id_b, round(distance_m, 6) AS distance_m,
row_number() OVER (ORDER BY round(distance_m, 6), street_id_a, street_id_b)::INT AS place FROM near_pairs JOIN na USING (way_id_a, way_id_b) JOIN nb USING (way_id_a, way_id_b)""")
def near_miss_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streets.near_misses(c._stored_lines(spark, sf_dir), c.THRESHOLD, geo.Identity())
    return _placed(found).withColumn("distance_m", F.round("distance_m", 6))


def _placed(ordered: DataFrame) -> DataFrame:
    """Adds ``place``, the number of each row in the order it comes (results of a report's size)."""
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


@query(f"""WITH RECURSIVE {o.POINTS_SQL}, {c._tm_sql()}, k AS (SELECT norm_name, sqrt(var_pop(x) + var_pop(y)) / 1000 AS s FROM metric GROUP BY 1 HAVING count(*) > 5),
u AS (SELECT norm_name, CASE WHEN max(s) OVER () = min(s) OVER () THEN 0 ELSE 1 - (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS score FROM k)
SELECT norm_name, row_number() OVER (ORDER BY round(score, 9) DESC, norm_name)::INT AS place FROM u""")
def kpi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(stats.kpis(c._points(spark, sf_dir), 5)).select("norm_name", "place")


# ---- text files
def _text_lines(spark: SparkSession, text: str) -> DataFrame:
    """(place, line) of a small text, the first line is 1."""
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines(), 1)], "place int, line string")


@query(f"WITH RECURSIVE {o.STREETS_SQL}, g AS (SELECT norm_name, min(name) AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, norm_name) AS r FROM streets GROUP BY 1) SELECT 1 AS place, 'count' || chr(9) || 'norm_name' || chr(9) || 'name' AS line UNION ALL SELECT (r + 1)::INT, n || chr(9) || norm_name || chr(9) || name FROM g WHERE r <= 10")
def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = io.StringIO()
    sinks.print_groups(streets.top_groups(streets.street_groups(c._streets(spark, sf_dir))).collect(), text)
    return _text_lines(spark, text.getvalue())


@query(f"WITH RECURSIVE {_NEAR_SQL} SELECT (row_number() OVER (ORDER BY round(distance_m, 6), street_id_a, street_id_b) + 1)::INT AS place, printf('%.2f', distance_m) || chr(9) || way_id_a || chr(9) || way_id_b || chr(9) || norm_name || chr(9) || norm_name AS line FROM near_pairs UNION ALL SELECT 1, 'distance_m' || chr(9) || 'way_id_a' || chr(9) || 'way_id_b' || chr(9) || 'norm_name' || chr(9) || 'name'")
def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = io.StringIO()
    found = streets.near_misses(c._stored_lines(spark, sf_dir), c.THRESHOLD, geo.Identity())
    sinks.print_pairs(found.toLocalIterator(), text)
    discard(found)  # the stored lines, too: the text is all that is left to use
    return _text_lines(spark, text.getvalue())


@query(f"WITH {c._NAMES_SQL}, w AS (SELECT list_filter(l, lambda x: x <> '')[1] AS word FROM g), t AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS r FROM w WHERE word IS NOT NULL AND word NOT IN ({c._TYPES_SQL}) GROUP BY word) SELECT r::INT AS place, n || chr(9) || word AS line FROM t WHERE r <= 50")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = io.StringIO()
    sinks.print_words(points.first_words(o.names(spark, sf_dir)).collect(), text)
    return _text_lines(spark, text.getvalue())


@query(f"""WITH RECURSIVE {o.POINTS_SQL}, {c._tm_sql()}, k AS (SELECT norm_name, count(*) AS n, avg(lon) AS lon, avg(lat) AS lat, sqrt(var_pop(x) + var_pop(y)) / 1000 AS s FROM metric GROUP BY 1 HAVING count(*) > 5),
u AS (SELECT *, CASE WHEN max(s) OVER () = min(s) OVER () THEN 0 ELSE 1 - (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS score FROM k)
SELECT '{",".join(stats.KPI_COLUMNS)}' AS line UNION ALL SELECT norm_name || ',' || n || ',' || printf('%.6f', round(lon, 9)) || ',' || printf('%.6f', round(lat, 9)) || ',' || printf('%.3f', round(s, 9)) || ',,,,,,' || printf('%.4f', round(score, 9)) FROM u""")
def kpi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = io.StringIO()
    found = stats.kpis(c._points(spark, sf_dir), 5)
    # Means may lie half-way between two printed numbers: what both sides print is rounded alike before.
    found = found.select(*(F.round(k, 9).alias(k) if t == "double" else k for k, t in found.dtypes))
    sinks.write_kpis(found.toLocalIterator(), text)
    return _text_lines(spark, text.getvalue()).select("line")


@query(f"WITH {c._MERGE_SQL} SELECT name, osm_id, first, second, (row_number() OVER (ORDER BY osm_id = 'total', area_seq) - 1)::BIGINT AS seq FROM (SELECT name, osm_id, first, second, (regexp_extract(osm_id, '[0-9]+'))::BIGINT AS area_seq FROM m UNION ALL SELECT 'Total', 'total', count_if(first = 'true')::VARCHAR, count_if(second = 'true')::VARCHAR, 0 FROM m)")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide report written by one run, merged into by another, and read again, in its order."""
    path = scratch_path(spark, "report") + ".csv"
    path = path if "://" in path or path.startswith("/") else f"file://{path}"
    write_text(path, "name,postal_code,istat,catasto,wikidata,osm_id\n", spark)  # makes the folder on remote file systems
    sinks.write_report(spark, path, c._report(spark, sf_dir, "first", "07").where("seq < 28"), "first")
    sinks.write_report(spark, path, c._report(spark, sf_dir, "second", "12").where("seq >= 14"), "second")
    return sinks.read_report(spark, path).select("name", "osm_id", "first", "second", "seq")


@query(f"WITH {c.ALIASES_SQL} SELECT line + 1 AS line, variant, canonical FROM al WHERE variant <> 'ghost'")
def alias_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias file with comments, blank lines and a key mapped to itself, parsed."""
    rows = o.table(spark, sf_dir, "customer").where("c_custkey between 20 and 59").select("c_custkey").orderBy("c_custkey").collect()
    key = lambda n: f"customer{n:09d}"
    path = scratch_path(spark, "aliases") + ".txt"
    write_text(path, "# variants\n\n" + "\n".join(f"  {key(r.c_custkey)} = {key(r.c_custkey % 10 + 1)}  " for r in rows) + "\nsame=same\n", spark)
    mapping = config_files.parse_aliases(path)
    config_files.check_aliases(mapping)
    return aliases.mapping_frame(spark, mapping).select((F.col("line") + 1).alias("line"), "variant", "canonical")


@query("SELECT p_partkey, p_name FROM part WHERE (translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%r_d%' OR p_name LIKE '% gear') AND p_name NOT LIKE '%hot%'")
def pattern_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a pattern file asks for."""
    from odonymy.functions.names import matches

    path = scratch_path(spark, "patterns") + ".txt"
    write_text(path, "# names\n%R_d%\n\n% GEAR\n-  %hot%\n-\n", spark)
    wanted = config_files.parse_patterns(path)
    return o.table(spark, sf_dir, "part").where(matches(F.col("p_name"), wanted.includes, wanted.excludes)).select("p_partkey", "p_name")


_SUFFIXES = (".osm.pbf", ".OSM.XML", ".osm.bz2", ".osm.gz", ".osm", ".Pbf", ".csv")


@query(f"""WITH s AS (SELECT n_name, [{", ".join(f"'{x}'" for x in _SUFFIXES)}][n_nationkey % 7 + 1] AS x FROM nation)
SELECT n_name || x AS file, CASE WHEN x <> '.csv' THEN lower(x) END AS format, '/d/' || n_name || CASE WHEN x = '.OSM.XML' THEN '.OSM' ELSE '' END || '.db' AS store FROM s""")
def dump_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.n_name + _SUFFIXES[r.n_nationkey % 7] for r in o.table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()]  # 25 nations
    return spark.createDataFrame([(n, osm.detect_format(f"/d/{n}"), config_files.store_path(f"/d/{n}")) for n in names], "file string, format string, store string")


# ---- labels, outlines, summaries
@query(f"WITH RECURSIVE {o.STREETS_SQL}, {c.ALIASES_SQL}, r AS (SELECT coalesce(canonical, norm_name) AS norm_name, name FROM streets LEFT JOIN al ON norm_name = variant), n AS (SELECT norm_name, name, row_number() OVER (PARTITION BY norm_name ORDER BY count(*) DESC, name) AS k FROM r GROUP BY 1, 2) SELECT norm_name, name FROM n WHERE k = 1")
def street_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names of groups of streets, after several groups were put under one key."""
    return streets.street_display_names(aliases.relabelled(c._streets(spark, sf_dir), aliases.mapping_frame(spark, c.ALIASES)))


@query(f"""WITH {c._CITY_POINTS_SQL.replace("points AS", "hits AS")}, towns AS (SELECT area_seq, x0, y0, EXISTS (SELECT 1 FROM hits WHERE {o.INSIDE}) AS matched FROM areas WHERE admin_level = '8'),
points AS (SELECT area_seq, matched, i, x0 + {o.STRIP}::DOUBLE * (i IN (1, 2))::INT AS lon, y0 + {o.STRIP}::DOUBLE * (i IN (2, 3))::INT AS lat FROM towns, (SELECT unnest(range(5))::INT AS i)), {c._tm_sql()}
SELECT area_seq, matched, i, round(x, 2) AS x, round(y, 2) AS y FROM metric""")
def city_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the municipality drawing is made of: outer rings in the plane."""
    found = points.matched_ways(o.ways(spark, sf_dir), ["%7"]).unionByName(points.matched_squares(o.squares(spark, sf_dir), ["%7"]))
    rows = sinks.city_outlines(cities.flagged(cities.municipalities(o.areas(spark, sf_dir)), found), geo.TransverseMercator())
    return rows.select("area_seq", "matched", F.posexplode(F.flatten("rings")).alias("i", "p")).select("area_seq", "matched", "i", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query(f"""WITH RECURSIVE {o.POINTS_SQL}, {c._tm_sql()}, {o.AREAS_SQL}, {c.ALIASES_SQL}, cells AS (SELECT count(*) AS n FROM metric GROUP BY floor(x / 50000), floor(y / 50000))
SELECT 'streets' AS what, (SELECT count(*) FROM streets)::BIGINT AS n UNION ALL SELECT 'areas', (SELECT count(*) FROM areas) UNION ALL SELECT 'relabelled', (SELECT count(*) FROM streets JOIN al ON norm_name = variant)
UNION ALL SELECT 'scored', (SELECT count(*) FROM cells WHERE n >= 5) UNION ALL SELECT 'sparse', (SELECT count(*) FROM cells WHERE n < 5)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that commands end with."""
    made, ways = c._made(spark, sf_dir)
    cells = points.grid(points.street_points(made, ways), "customer000000001", 50_000, 5)
    one = lambda rows, what, value: rows.agg(F.lit(what).alias("what"), value.cast("long").alias("n"))
    moved = aliases.relabel_counts(made, aliases.mapping_frame(spark, c.ALIASES))
    counts = (one(made, "streets", F.count("*")), one(o.areas(spark, sf_dir), "areas", F.count("*")), one(moved, "relabelled", F.sum("moved")), one(cells, "scored", F.count_if("populated")), one(cells, "sparse", F.count_if(~F.col("populated"))))
    out = counts[0]
    for rows in counts[1:]:
        out = out.union(rows)
    return out
