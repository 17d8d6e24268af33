import pytest
from test_points_stats import box

from odonymy import paths, sinks
from odonymy.functions.geo import POLYGONS
from odonymy.operators import cities

AREAS = f"area_seq long, osm_id long, from_way boolean, admin_level string, name string, postal_code string, istat string, catasto string, wikidata string, geometry {POLYGONS}"


@pytest.fixture(scope="module")
def areas(spark):
    def build(*rows):
        full = [(i, osm, False, level, name, None, istat, None, wiki, shape) for i, (osm, level, name, istat, wiki, shape) in enumerate(rows)]
        return spark.createDataFrame(full, AREAS)

    return build


@pytest.fixture(scope="module")
def two(areas):
    return areas((1, "8", "A", "001", None, box(0, 0, 10, 10)), (2, "8", "B, town", "002", "Q1", box(20, 20, 30, 30)))


def spots(spark, *at):
    return spark.createDataFrame([(float(x), float(y)) for x, y in at], "lon double, lat double")


def test_flags_inside_edge_and_outside(spark, two):
    flags = lambda *at: {r.name: r.matched for r in cities.flagged(two, spots(spark, *at)).collect()}
    assert flags((0, 5), (50, 50)) == {"A": True, "B, town": False}
    assert flags((5, 5), (25, 25), (15, 15)) == {"A": True, "B, town": True}


def test_a_shared_border_flags_both(spark, areas):
    both = areas((1, "8", "A", None, None, box(0, 0, 5, 5)), (2, "8", "B", None, None, box(5, 0, 9, 5)))
    assert cities.flagged(both, spots(spark, (5, 1))).where("matched").count() == 2


def test_clip_to_a_parent_and_unknown_parent(areas):
    every = areas((9, "4", "Region", None, None, box(0, 0, 12, 12)), (1, "8", "In", None, None, box(1, 1, 3, 3)), (2, "8", "Across", None, None, box(11.5, 0, 20, 9)))
    assert [r.name for r in cities.municipalities(every, 9).collect()] == ["In"]
    assert cities.municipalities(every).count() == 2
    with pytest.raises(cities.RegionError, match="9"):
        cities.municipalities(every, 77)


def merged(spark, path, flagged, column):
    n = sinks.write_report(spark, path, cities.report(flagged, column), column)
    return n, path.read_text()


def test_report_is_created_extended_overwritten_and_appended(spark, two, tmp_path):
    path = tmp_path / "x-cities.csv"
    n, text = merged(spark, path, cities.flagged(two, spots(spark, (5, 5))), "roma")
    head = "name,postal_code,istat,catasto,wikidata,osm_id,roma"
    assert n == 2 and text == f'{head}\nA,,001,,,relation/1,true\n"B, town",,002,,Q1,relation/2,false\nTotal,,,,,total,1\n'
    only_b = two.where("name <> 'A'")
    n, text = merged(spark, path, cities.flagged(only_b, spots(spark, (25, 25))), "marx")
    assert n == 1 and text == f'{head},marx\nA,,001,,,relation/1,true,\n"B, town",,002,,Q1,relation/2,false,true\nTotal,,,,,total,1,1\n'
    # The same column again: a town that the run lacks keeps its old cell.
    _, text = merged(spark, path, cities.flagged(only_b, spots(spark, (25, 25))), "roma")
    assert text.splitlines()[1:] == ["A,,001,,,relation/1,true,", '"B, town",,002,,Q1,relation/2,true,true', "Total,,,,,total,2,1"]


def test_rows_append_behind_and_wikidata_is_no_key(spark, areas, tmp_path):
    path = tmp_path / "y.csv"
    one = areas((1, "8", "A", "1", "Q", box(0, 0, 1, 1)))
    more = areas((3, "8", "C", "3", "Q", box(5, 5, 6, 6)), (1, "8", "A", "1", "Q", box(0, 0, 1, 1)))
    merged(spark, path, cities.flagged(one, spots(spark)), "p")
    _, text = merged(spark, path, cities.flagged(more, spots(spark, (5.5, 5.5))), "q")
    assert text.splitlines()[1:] == ["A,,1,,Q,relation/1,false,false", "C,,3,,Q,relation/3,,true", "Total,,,,,total,0,1"]


def test_repeated_id_in_a_run_is_one_row(spark, areas, tmp_path):
    twice = areas((1, "8", "Old", "1", None, box(0, 0, 1, 1)), (1, "8", "New", "1", None, box(5, 5, 6, 6)))
    n, text = merged(spark, tmp_path / "z.csv", cities.flagged(twice, spots(spark, (0.5, 0.5))), "p")
    assert n == 2 and text.splitlines()[1:] == ["New,,1,,,relation/1,false", "Total,,,,,total,0"]


def test_pattern_reports_merge_by_istat(spark):
    cols = ", ".join(f"{c} string" for c in cities.ID_COLUMNS)
    part = lambda col, *vals: spark.createDataFrame([("A", "", "1", "", "", "r/1", vals[0]), ("B", "", "2", "", "", "r/2", vals[1])], f"{cols}, {col} string")
    got = cities.merge_by_istat({"x": part("m", "true", "false"), "y": part("m", "false", "true")})
    assert [(r.name, r.x, r.y) for r in got.collect()] == [("A", "true", "false"), ("B", "false", "true")]
    wrong = spark.createDataFrame([("A", "", "1", "", "", "r/9", "true")], f"{cols}, m string")
    with pytest.raises(ValueError, match="y"):
        cities.merge_by_istat({"x": part("m", "true", "false"), "y": wrong})


def test_drawing(spark, two, tmp_path):
    from odonymy.functions.geo import Identity

    path, n = sinks.draw_cities(cities.flagged(two, spots(spark, (5, 5))), tmp_path / "m.png", "roma", Identity())
    drawn = paths.read_text(path)
    assert path.endswith("m.svg") and n == 2 and drawn.count("<path") == 2 + 1 and "#d7301f" in drawn
