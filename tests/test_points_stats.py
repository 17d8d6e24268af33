import math

import pytest
from pyspark.sql import functions as F

from odonymy.functions.geo import POLYGONS, Identity
from odonymy.operators import points, stats

AREAS = f"area_seq long, osm_id long, from_way boolean, admin_level string, name string, geometry {POLYGONS}"


def box(x0, y0, x1, y1):
    return [[[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]]


@pytest.fixture(scope="module")
def at(spark):
    def build(rows):
        return spark.createDataFrame([(n, float(x), float(y)) for n, x, y in rows], "norm_name string, lon double, lat double")

    return build


@pytest.fixture(scope="module")
def regions(spark):
    def build(*rows, level="4"):
        return spark.createDataFrame([(i, 100 + i, False, level, name, shape) for i, (name, shape) in enumerate(rows)], AREAS)

    return build


def by_name(frame):
    return {r.norm_name: r for r in frame.collect()}


def test_centroid_counts_vertices_of_each_way(spark):
    ways = spark.createDataFrame([(1, [{"node_id": 1, "lon": 0.0, "lat": 0.0}, {"node_id": 2, "lon": 3.0, "lat": 0.0}]), (2, [{"node_id": 2, "lon": 3.0, "lat": 6.0}]), (3, [])], "way_id long, coords array<struct<node_id:long,lon:double,lat:double>>")
    made = spark.createDataFrame([(1, "a", [1, 2, 99]), (3, "b", [3])], "street_id long, norm_name string, way_ids array<long>")
    assert [(r.street_id, r.lon, r.lat) for r in points.street_points(made, ways).collect()] == [(1, 2.0, 2.0)]


def test_grid_cells_floor_scale_and_sparse_flag(at):
    rows = [("t", 1, 1), ("u", 2, 2), ("t", -1, -1), *[("u", 15, 5)] * 2]
    cells = {(r.x, r.y): r for r in points.grid(at(rows), "t", 10.0, 2, Identity()).collect()}
    assert {k: (r.total, r.matches, r.populated) for k, r in cells.items()} == {(0.0, 0.0): (2, 1, True), (-10.0, -10.0): (1, 1, False), (10.0, 0.0): (2, 0, True)}
    one = cells[(0.0, 0.0)]
    assert (one.total_streets, one.matching_streets, one.global_ratio, one.lq) == (5, 2, 0.25, 2.0)


def test_grid_without_matches_or_populated_cells(at):
    cells = points.grid(at([("a", 1, 1)]), "zzz", 10.0, 2, Identity()).collect()
    assert [(c.global_ratio, c.lq) for c in cells] == [(0.0, 0.0)]
    assert points.grid(at([]), "a", 10.0, 1, Identity()).count() == 0
    with pytest.raises(ValueError):
        points.grid(at([]), "a", 0, 1, Identity())


def test_first_words(spark):
    names = ["Corso Roma", "Largo X", "Vicoletto A", "vicoletto B", "1° Maggio", "--", None, "Zeta"]
    got = [(r.word, r["count"]) for r in points.first_words(spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert got == [("vicoletto", 2), ("1", 1), ("zeta", 1)]


def test_spread_of_unit_square_and_strict_floor(at):
    square = [("a", 0, 0), ("a", 1, 0), ("a", 0, 1), ("a", 1, 1), ("b", 0, 0), ("b", 1, 1)]
    got = by_name(stats.kpis(at(square), 2, Identity()))
    assert list(got) == ["a"]
    assert (got["a"]["count"], got["a"].mean_lon, got["a"].mean_lat) == (4, 0.5, 0.5)
    assert got["a"].std_distance_km == pytest.approx(math.sqrt(0.5) / 1000)
    assert got["a"].top_region is None and got["a"].skew_score == 0


def test_tight_before_wide_and_ties_by_name(at):
    rows = [(n, k * s, 0) for n, s in (("wide", 1000), ("tight", 1), ("aaa", 1000)) for k in range(3)]
    assert [r.norm_name for r in stats.kpis(at(rows), 2, Identity()).collect()] == ["tight", "aaa", "wide"]


def test_real_projection(at):
    got = stats.kpis(at([("a", 7.3, 45), ("a", 7.3, 46)]), 1).first()
    assert got.mean_lat == 45.5 and 40 < got.std_distance_km < 70


def test_top_region_share_and_quotient(at, regions):
    big, small = (1, 1), (20.5, 0.5)
    rows = [("target", *big)] * 2 + [("target", *small)] * 2 + [("filler", *big)] * 10 + [("filler", *small)]
    got = by_name(stats.kpis(at(rows), 1, Identity(), regions(("Big", box(0, 0, 10, 10)), ("Small", box(20, 0, 21, 1)))))["target"]
    assert got.top_region == "Small" and got.top_region_share == pytest.approx(2 / 3) and got.top_region_lq == pytest.approx((2 / 3) / (4 / 15))


def test_even_solo_and_dense_names(at, regions):
    four = [(n, box(10 * i, 0, 10 * i + 5, 5)) for i, n in enumerate("ABCD")]
    even = [("even", 1, 1)] * 3 + [("even", 11, 1)] * 3
    got = by_name(stats.kpis(at(even + [("solo", 1, 1)] * 4), 1, Identity(), regions(*four[:2])))
    assert got["solo"].effective_regions == pytest.approx(1) and got["solo"].region_gini == pytest.approx(0.5)
    dense = [("d", 1, 1)] * 4 + [("x", 1, 1)] * 4 + [("d", 11, 1), ("x", 11, 1)]
    got = by_name(stats.kpis(at(dense), 1, Identity(), regions(*four[:2])))
    assert got["d"].effective_regions == pytest.approx(2) and got["d"].region_gini == pytest.approx(0, abs=1e-12)
    got = by_name(stats.kpis(at([("solo", 1, 1)] * 4), 1, Identity(), regions(*four)))
    assert got["solo"].region_gini == pytest.approx(0.75)


def test_unplaced_and_unnamed_regions(at, regions):
    got = by_name(stats.kpis(at([("out", 99, 99)] * 3 + [("in", 1, 1)] * 3), 1, Identity(), regions((None, box(0, 0, 5, 5)))))
    assert got["out"].top_region is None and got["out"].region_gini is None
    assert got["in"].top_region == "relation/100"


def test_first_region_in_read_order_wins(at, regions):
    got = stats.kpis(at([("a", 5, 1)] * 3), 1, Identity(), regions(("One", box(0, 0, 5, 5)), ("Two", box(5, 0, 9, 5)))).first()
    assert got.top_region == "One"


def test_header(spark):
    rows = spark.createDataFrame([("Via A", "a"), (None, None), ("Via B", "b")], "name string, norm_name string")
    assert points.header(rows).first()[:] == (3, 1, 2)


def test_matches_drop_ways_without_points(spark):
    rows = spark.createDataFrame([("Via Roma", [{"node_id": 1, "lon": 7.3, "lat": 45.7}, {"node_id": 2, "lon": 7.33, "lat": 45.75}]), ("Via Roma", []), ("Via Pasquale Roma", [{"node_id": 1, "lon": 1.0, "lat": 1.0}])], "name string, coords array<struct<node_id:long,lon:double,lat:double>>")
    assert [(r.lon, r.lat) for r in points.matched_ways(rows, ["% roma"], ["%PASQUALE%"]).collect()] == [(7.33, 45.75)]
    assert points.matched_squares(rows.select("name", F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")), ["%quale%"]).count() == 1
