"""Registry of the queries over the driver's tables and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonymy.functions import geo
from odonymy.functions import names as text
from odonymy.operators import aliases, cities, points, stats, streets
from odonymy.plans import overlay as o
from odonymy.session import materialize, parts_of, release, split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 100.25
ALIASES = {f"customer{i:09d}": f"customer{i % 10 + 1:09d}" for i in range(20, 60)} | {"ghost": "customer000000001"}
ALIASES_SQL = "al(variant, canonical, line) AS (SELECT variant, 'customer' || lpad((i % 10 + 1)::VARCHAR, 9, '0'), i - 20 FROM (SELECT i, 'customer' || lpad(i::VARCHAR, 9, '0') AS variant FROM range(20, 60) t(i)) UNION ALL SELECT 'ghost', 'customer000000001', 40)"


def query(sql: str) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return enter


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_TYPES_SQL = ", ".join(f"'{t}'" for t in text.STREET_TYPES)
_FOLD_SQL = "replace(replace(strip_accents(lower({})), 'ß', 'ss'), 'œ', 'œ')"
_NAMES_SQL = rf"""
n AS (SELECT doc_id, text AS name, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS t FROM documents),
f AS (SELECT doc_id, name, list_transform(t, lambda x: {_FOLD_SQL.format("x")}) AS t FROM n),
g AS (SELECT doc_id, name, list_transform(t, lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')) AS l, coalesce(list_position(list_transform(t, lambda x: x IN ({_TYPES_SQL})), false), 0) AS k FROM f)"""


@query(f"WITH {_NAMES_SQL} SELECT doc_id, name, array_to_string(CASE WHEN k > 1 THEN l[k:] ELSE l END, '') AS norm_name, list_filter(l, lambda x: x <> '')[1] AS first_word FROM g")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return o.names(spark, sf_dir).select("doc_id", "name", text.normalize_name(n).alias("norm_name"), text.first_word(n).alias("first_word"))


@query(f"WITH {_NAMES_SQL}, w AS (SELECT list_filter(l, lambda x: x <> '')[1] AS word FROM g) SELECT word, count(*)::BIGINT AS count FROM w WHERE word IS NOT NULL AND word NOT IN ({_TYPES_SQL}) GROUP BY word ORDER BY count DESC, word LIMIT 50")
def first_word_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.first_words(o.names(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey, p_name, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM part)
SELECT p_partkey, p_name FROM p WHERE (n LIKE '%r_d%' OR n LIKE '%1_%') AND n NOT LIKE '%9'""")
def like_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.table(spark, sf_dir, "part").where(text.matches(F.col("p_name"), ["%R_d%", "%1_%"], ["%9"])).select("p_partkey", "p_name")


@query(f"WITH {o.WAYS_SQL}, c AS (SELECT norm_name, name, count(*) AS n FROM ways GROUP BY 1, 2) SELECT norm_name, name FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY n DESC, name) AS r FROM c) WHERE r = 1")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.display_names(o.ways(spark, sf_dir))


@query(f"WITH {o.WAYS_SQL} SELECT count(*)::BIGINT AS parsed_count, count_if(name IS NULL)::BIGINT AS unnamed_count, count(DISTINCT norm_name)::BIGINT AS group_count FROM ways")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.header(o.ways(spark, sf_dir))


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT way_id, norm_name, component FROM labelled")
def certain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.components(o.ways(spark, sf_dir)).select("way_id", "norm_name", "component")


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(streets, ways); the ways are stored, as several steps read them."""
    ways = materialize(o.ways(spark, sf_dir), "overlay-ways")
    return streets.streets(streets.components(ways)), ways


def _streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir)[0]


def _stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = o.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    made = materialize(split(o.lines(spark, sf_dir), parts_of(read), "way_id"), "overlay-lines")
    release(spark)
    return made


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT norm_name, name, array_to_string(way_ids, ',') AS way_ids, street_id FROM streets")
def all_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streets(spark, sf_dir).withColumn("way_ids", F.array_join(F.transform("way_ids", lambda w: w.cast("string")), ","))


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT norm_name, min(name) AS name, count(*)::BIGINT AS count FROM streets GROUP BY 1")
def street_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.street_groups(_streets(spark, sf_dir))


@query(f"WITH RECURSIVE {o.STREETS_SQL} SELECT norm_name, min(name) AS name, count(*)::BIGINT AS count FROM streets GROUP BY 1 ORDER BY count DESC, norm_name LIMIT 10")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.top_groups(streets.street_groups(_streets(spark, sf_dir)))


@query(f"WITH RECURSIVE {o.STREETS_SQL}, {ALIASES_SQL} SELECT street_id, coalesce(canonical, norm_name) AS norm_name, name FROM streets LEFT JOIN al ON norm_name = variant")
def alias_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.relabelled(_streets(spark, sf_dir), aliases.mapping_frame(spark, ALIASES)).select("street_id", "norm_name", "name")


@query(f"WITH RECURSIVE {o.STREETS_SQL}, {ALIASES_SQL} SELECT variant, canonical, line, count(street_id)::BIGINT AS moved FROM al LEFT JOIN streets ON norm_name = variant GROUP BY ALL")
def alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.relabel_counts(_streets(spark, sf_dir), aliases.mapping_frame(spark, ALIASES))


@query(f"WITH {o.WAYS_SQL}, {ALIASES_SQL} SELECT line, variant, canonical FROM al ANTI JOIN (SELECT DISTINCT norm_name AS variant FROM ways) USING (variant)")
def alias_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.unknown(aliases.mapping_frame(spark, ALIASES), o.ways(spark, sf_dir))


@query("""WITH m AS (SELECT (n_nationkey)::INT AS line, n_name AS variant, CASE WHEN n_nationkey % 3 = 0 THEN lag(n_name) OVER (ORDER BY n_nationkey) ELSE lower(n_name) END AS canonical FROM nation)
SELECT line, variant, canonical FROM m WHERE canonical IN (SELECT variant FROM m)""")
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("n_name").over(Window.orderBy("n_nationkey"))  # 25 nations
    rows = o.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_name").alias("variant"), F.when(F.col("n_nationkey") % 3 == 0, before).otherwise(F.lower("n_name")).alias("canonical"))
    return aliases.chained(rows)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.street_points(*_made(spark, sf_dir))


@query(f"WITH RECURSIVE {o.POINTS_SQL} SELECT street_id, norm_name, round(lon, 9) AS lon, round(lat, 9) AS lat FROM points")
def street_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("street_id", "norm_name", _r("lon", 9), _r("lat", 9))


@query(f"WITH {o.WAYS_SQL}, m AS (SELECT name, node_ids[len(node_ids) // 2 + 1] AS n FROM ways WHERE lower(name) LIKE '%1' AND lower(name) NOT LIKE 'piazza %') SELECT name, round(7.0 + (n * 7919) % 10007 / 1000.0::DOUBLE, 9) AS lon, round(37.0 + (n * 104729) % 10009 / 1000.0::DOUBLE, 9) AS lat FROM m")
def matched_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.matched_ways(o.ways(spark, sf_dir), ["%1"], ["Piazza %"]).select("name", _r("lon", 9), _r("lat", 9))


@query("SELECT 'Piazza ' || s_name AS name, round(7.0 + (s_suppkey * 7919) % 10007 / 1000.0::DOUBLE, 9) AS lon, round(37.0 + (s_suppkey * 104729) % 10009 / 1000.0::DOUBLE, 9) AS lat FROM supplier WHERE s_name LIKE '%3'")
def matched_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.matched_squares(o.squares(spark, sf_dir), ["piazza %3"]).select("name", _r("lon", 9), _r("lat", 9))


_TM = geo.TransverseMercator()


def _tm_sql() -> str:
    """Transverse Mercator in SQL, from lon and lat."""
    import math

    f = _TM.flattening
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    a = _TM.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * _TM.scale
    s = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    x = " + ".join(["eta", *(f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(s, 1))])
    y = " + ".join(["xi", *(f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(s, 1))])
    return f"""t1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS tt, radians(lon - 12) AS la FROM points),
t2 AS (SELECT *, atan2(tt, cos(la)) AS xi, asinh(sin(la) / sqrt(tt * tt + cos(la) * cos(la))) AS eta FROM t1),
metric AS (SELECT *, 7000000 + {a!r}::DOUBLE * ({x}) AS x, {a!r}::DOUBLE * ({y}) AS y FROM t2)"""


@query(f"WITH points AS (SELECT p_partkey, 7.0 + (p_partkey * 7919) % 10007 / 1000.0::DOUBLE AS lon, 37.0 + (p_partkey * 104729) % 10009 / 1000.0::DOUBLE AS lat FROM part), {_tm_sql()} SELECT p_partkey, round(x, 3) AS x, round(y, 3) AS y FROM metric")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    x, y = _TM.xy(o.node_lon(n), o.node_lat(n))
    return o.table(spark, sf_dir, "part").select(n, F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH RECURSIVE {o.POINTS_SQL}, {_tm_sql()},
c AS (SELECT floor(x / 50000) AS col, floor(y / 50000) AS row, count(*)::BIGINT AS total, count_if(norm_name = 'customer000000001')::BIGINT AS matches FROM metric GROUP BY 1, 2),
g AS (SELECT sum(total)::BIGINT AS total_streets, sum(matches)::BIGINT AS matching_streets, coalesce(sum(matches) FILTER (total >= 5) / sum(total) FILTER (total >= 5), 0)::DOUBLE AS gr FROM c)
SELECT col * 50000::DOUBLE AS x, row * 50000::DOUBLE AS y, total, matches, round(matches / total, 6) AS ratio, total >= 5 AS populated, total_streets, matching_streets, round(gr, 9) AS global_ratio, CASE WHEN gr = 0 THEN 0 ELSE round(matches / total / gr, 6) END AS lq FROM c, g""")
def grid_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points.grid(_points(spark, sf_dir), "customer000000001", 50_000, 5)
    return cells.select("x", "y", "total", "matches", _r("ratio"), "populated", "total_streets", "matching_streets", _r("global_ratio", 9), _r("lq"))


_CITY_POINTS_SQL = f"{o.WAYS_SQL}, m AS (SELECT node_ids[len(node_ids) // 2 + 1] AS n FROM ways WHERE name LIKE '%7' UNION ALL SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7'), points AS (SELECT 7.0 + (n * 7919) % 10007 / 1000.0::DOUBLE AS lon, 37.0 + (n * 104729) % 10009 / 1000.0::DOUBLE AS lat FROM m), {o.AREAS_SQL}"


def _report(spark: SparkSession, sf_dir: str, column: str = "seven", digit: str = "7") -> DataFrame:
    found = points.matched_ways(o.ways(spark, sf_dir), [f"%{digit}"]).unionByName(points.matched_squares(o.squares(spark, sf_dir), [f"%{digit}"]))
    return cities.report(cities.flagged(cities.municipalities(o.areas(spark, sf_dir)), found), column)


@query(f"WITH {_CITY_POINTS_SQL} SELECT 'relation/' || osm_id AS osm_id, name, EXISTS (SELECT 1 FROM points WHERE {o.INSIDE})::VARCHAR AS seven FROM areas WHERE admin_level = '8'")
def city_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("osm_id", "name", "seven")


@query(f"WITH {_CITY_POINTS_SQL} SELECT count_if(EXISTS (SELECT 1 FROM points WHERE {o.INSIDE}))::BIGINT AS hits, count(*)::BIGINT AS cities FROM areas WHERE admin_level = '8'")
def city_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).agg(cities.true_count(F.col("seven")).alias("hits"), F.count("*").alias("cities"))


@query(f"WITH {o.AREAS_SQL} SELECT t.osm_id::BIGINT AS osm_id, t.name FROM areas t JOIN areas r ON r.osm_id = 102 WHERE t.admin_level = '8' AND t.x0 + {o.STRIP / 2} BETWEEN r.x0 AND r.x0 + {o.STRIP}")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cities.municipalities(o.areas(spark, sf_dir), 102).select("osm_id", "name")


_KPI_SQL = f"""{o.POINTS_SQL}, {_tm_sql()}, {o.AREAS_SQL},
placed AS (SELECT street_id, norm_name, min(area_seq) AS area_seq, min_by(name, area_seq) AS name FROM points JOIN (SELECT * FROM areas WHERE admin_level = '4') ON {o.INSIDE} GROUP BY 1, 2),
cnt AS (SELECT norm_name, area_seq, name, count(*) AS n FROM placed GROUP BY 1, 2, 3),
al AS (SELECT area_seq, sum(n) AS all_n FROM cnt GROUP BY 1),
sh AS (SELECT *, n / all_n AS share, sum(n) OVER (PARTITION BY norm_name) AS nn, (SELECT sum(n) FROM cnt) AS pl FROM cnt JOIN al USING (area_seq)),
w AS (SELECT *, share / (nn / pl) AS lq, share / sum(share) OVER (PARTITION BY norm_name) AS w FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY w, area_seq) AS i, count(*) OVER (PARTITION BY norm_name) AS k, row_number() OVER (PARTITION BY norm_name ORDER BY lq DESC, area_seq) AS top FROM w),
reg AS (SELECT norm_name, max(CASE WHEN top = 1 THEN name END) AS top_region, max(CASE WHEN top = 1 THEN lq END) AS top_region_lq, max(CASE WHEN top = 1 THEN share END) AS top_region_share, exp(-sum(w * ln(w))) AS effective_regions, 2 * sum((4 - k + i) * w) / 4 - 5 / 4 AS region_gini FROM rk GROUP BY 1),
b AS (SELECT norm_name, count(*)::BIGINT AS count, avg(lon) AS mean_lon, avg(lat) AS mean_lat, sqrt(var_pop(x) + var_pop(y)) / 1000 AS std_distance_km FROM metric GROUP BY 1 HAVING count(*) > 5),
k AS (SELECT * FROM b LEFT JOIN reg USING (norm_name)),
u AS (SELECT *, {", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE {'1 - ' * inv}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS u{i}" for i, (c, inv) in enumerate((("std_distance_km", 1), ("top_region_lq", 0), ("top_region_share", 0), ("effective_regions", 1), ("region_gini", 0))))} FROM k)
SELECT norm_name, count, round(mean_lon, 9) AS mean_lon, round(mean_lat, 9) AS mean_lat, round(std_distance_km, 6) AS std_distance_km, top_region, round(top_region_lq, 6) AS top_region_lq, round(top_region_share, 6) AS top_region_share, round(effective_regions, 6) AS effective_regions, round(region_gini, 6) AS region_gini,
round(coalesce(list_avg(list_filter([u0, u1, u2, u3, u4], lambda x: x IS NOT NULL)), 0), 6) AS skew_score FROM u"""


@query(f"WITH RECURSIVE {_KPI_SQL}")
def name_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.kpis(materialize(_points(spark, sf_dir), "street-points"), 5, None, o.areas(spark, sf_dir))
    return found.select("norm_name", "count", *(c if c == "top_region" else _r(c, 9 if c.startswith("mean") else 6) for c in stats.KPI_COLUMNS[2:]))


@query(f"WITH RECURSIVE {o.POINTS_SQL}, {_tm_sql()} SELECT norm_name, count(*)::BIGINT AS count, round(avg(lon), 9) AS mean_lon, round(avg(lat), 9) AS mean_lat, round(sqrt(var_pop(x) + var_pop(y)) / 1000, 6) AS std_distance_km FROM metric GROUP BY 1 HAVING count(*) > 5")
def name_kpis_without_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kpis(_points(spark, sf_dir), 5).select("norm_name", "count", _r("mean_lon", 9), _r("mean_lat", 9), _r("std_distance_km"))


@query(f"WITH {o.LINES_SQL} SELECT a, b FROM gap WHERE d <= {THRESHOLD}")
def distance_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.distance_edges(o.lines(spark, sf_dir), THRESHOLD, geo.Identity())


_HEUR_SQL = f"""{o.LINES_SQL}, e AS (SELECT a, b FROM gap WHERE d <= {THRESHOLD} UNION SELECT b, a FROM gap WHERE d <= {THRESHOLD}),
reach(a, b) AS (SELECT way_id, way_id FROM l UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS way_id, min(b) AS component FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {_HEUR_SQL} SELECT norm_name, component, count(*)::BIGINT AS ways FROM comp JOIN l USING (way_id) GROUP BY 1, 2")
def heuristic_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.components(_stored_lines(spark, sf_dir), THRESHOLD, geo.Identity()).groupBy("norm_name", "component").agg(F.count("*").alias("ways"))


@query(f"""WITH RECURSIVE {_HEUR_SQL}, s AS (SELECT component, min(way_id) AS street_id FROM comp JOIN l USING (way_id) WHERE n >= 2 GROUP BY 1),
ws AS (SELECT way_id, street_id FROM comp JOIN s USING (component)),
p AS (SELECT norm_name, least(x.street_id, y.street_id) AS street_id_a, greatest(x.street_id, y.street_id) AS street_id_b, min(d) AS d FROM gap JOIN ws x ON x.way_id = a JOIN ws y ON y.way_id = b WHERE x.street_id <> y.street_id GROUP BY 1, 2, 3)
SELECT norm_name, street_id_a, street_id_b, round(d, 6) AS distance_m FROM p WHERE d >= {THRESHOLD} AND d < 2 * {THRESHOLD}""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.near_misses(_stored_lines(spark, sf_dir), THRESHOLD, geo.Identity()).select("norm_name", "street_id_a", "street_id_b", _r("distance_m"))


_MERGE_SQL = f"""{o.WAYS_SQL}, {o.AREAS_SQL},
pt AS (SELECT name, 7.0 + (n * 7919) % 10007 / 1000.0::DOUBLE AS lon, 37.0 + (n * 104729) % 10009 / 1000.0::DOUBLE AS lat FROM (SELECT name, node_ids[len(node_ids) // 2 + 1] AS n FROM ways UNION ALL SELECT 'Piazza ' || s_name, s_suppkey FROM supplier)),
r AS (SELECT name, 'relation/' || osm_id AS osm_id, area_seq, EXISTS (SELECT 1 FROM pt WHERE pt.name LIKE '%07' AND {o.INSIDE})::VARCHAR AS a, EXISTS (SELECT 1 FROM pt WHERE pt.name LIKE '%12' AND {o.INSIDE})::VARCHAR AS b FROM areas WHERE admin_level = '8'),
m AS (SELECT name, osm_id, CASE WHEN area_seq < 28 THEN a ELSE '' END AS first, CASE WHEN area_seq >= 14 THEN b ELSE '' END AS second FROM r)"""


@query(f"WITH {_MERGE_SQL} SELECT name, osm_id, first, second FROM m UNION ALL SELECT 'Total', 'total', count_if(first = 'true')::VARCHAR, count_if(second = 'true')::VARCHAR FROM m")
def wide_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cities.merge(None, _report(spark, sf_dir, "first", "07").where("seq < 28"), "first")
    old = one.withColumn("seq", F.monotonically_increasing_id())
    return cities.merge(old, _report(spark, sf_dir, "second", "12").where("seq >= 14"), "second").select("name", "osm_id", "first", "second")


@query(f"WITH {_MERGE_SQL} SELECT name, osm_id, a AS first, b AS second FROM r")
def istat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"first": _report(spark, sf_dir, "first", "07").drop("seq"), "second": _report(spark, sf_dir, "second", "12").drop("seq")}
    return cities.merge_by_istat(parts).select("name", "osm_id", "first", "second")


@query("""SELECT l_orderkey AS way_id, count(*)::BIGINT AS refs, count(p_partkey)::BIGINT AS resolved FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) ON l_partkey = p_partkey GROUP BY 1 HAVING count(p_partkey) >= 2""")
def resolved_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    from odonymy.sources import osm

    ways = o._vertices(spark, sf_dir).select(F.col("l_orderkey").alias("way_id"), F.col("v").alias("refs"), F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"))
    n = F.col("p_partkey")
    nodes = o.table(spark, sf_dir, "part").where("p_size > 2").select(n.alias("node_id"), o.node_lon(n).alias("lon"), o.node_lat(n).alias("lat"))
    return osm.highways(nodes, ways).select("way_id", F.size("node_ids").cast("long").alias("refs"), F.size("coords").cast("long").alias("resolved"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top street groups by number of distinct streets."""
    return QUERIES["top_groups"](spark, sf_dir)


from odonymy import catalog_files  # noqa: E402, F401  (enters its queries)
