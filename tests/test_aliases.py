import pytest

from odonymy.operators import aliases, streets
from odonymy.sources import config_files as files


def mapping(tmp_path, text):
    path = tmp_path / "a.txt"
    path.write_text(text, encoding="utf-8")
    return files.parse_aliases(path)


def test_lines(tmp_path):
    assert mapping(tmp_path, "# c\n\n a = b \nx=x\nm=n=o\nlast=z") == {"a": "b", "m": "n=o", "last": "z"}
    assert mapping(tmp_path, "x=x\nx=y\n") == {"x": "y"}


@pytest.mark.parametrize("text", ["a\n", "=b\n", "a=\n", "a=b\na=b\n", "a=b\na=c\n"])
def test_bad_lines(tmp_path, text):
    with pytest.raises(files.AliasError, match=r"a\.txt:\d"):
        mapping(tmp_path, text)


def test_chains_are_rejected(spark):
    with pytest.raises(files.AliasError, match="b"):
        files.check_aliases({"a": "b", "b": "c"})
    files.check_aliases({"a": "c", "b": "c"})
    found = aliases.chained(aliases.mapping_frame(spark, {"a": "b", "b": "c"})).collect()
    assert [(r.variant, r.canonical) for r in found] == [("a", "b")]


def test_relabel_counts_unknown_and_groups(spark):
    made = spark.createDataFrame([("carlomarx", "Via Carlo Marx", [1], 1), ("marx", "Via Marx", [2], 2), ("kmarx", "Karl-Marx-Strasse", [3], 3), ("roma", "Via Roma", [4], 4)], "norm_name string, name string, way_ids array<long>, street_id long")
    table = aliases.mapping_frame(spark, {"carlomarx": "karlmarx", "marx": "karlmarx", "kmarx": "karlmarx", "ghost": "karlmarx"})
    assert [(r.variant, r.moved) for r in aliases.relabel_counts(made, table).collect()] == [("carlomarx", 1), ("marx", 1), ("kmarx", 1), ("ghost", 0)]
    assert [r.variant for r in aliases.unknown(table, made).collect()] == ["ghost"]
    groups = {r.norm_name: (r.name, r["count"]) for r in streets.street_groups(aliases.relabelled(made, table)).collect()}
    assert groups == {"karlmarx": ("Karl-Marx-Strasse", 3), "roma": ("Via Roma", 1)}


def test_patterns(tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("# x\n % Roma\n-  %vecchia%\n-\n% Roma\n")
    assert files.parse_patterns(path) == files.Patterns(["% Roma", "% Roma"], ["%vecchia%"])
    path.write_text("# x\n-a\n")
    with pytest.raises(files.PatternError):
        files.parse_patterns(path)


def test_default_paths():
    from pathlib import Path

    p = Path("/d/italy.osm.pbf")
    assert [str(files.store_path(Path(f"/d/{n}"))) for n in ("italy.osm.pbf", "r.osm.xml", "p.osm.gz", "q.OSM", "x.txt")] == [f"/d/{n}.db" for n in ("italy", "r", "p", "q", "x")]
    db = files.store_path(p)
    assert str(files.alias_path(db)) == "/d/aliases.txt" and str(files.map_path(db, "roma")) == "/d/italy-roma.png"
    assert str(files.cities_path(db)) == "/d/italy-cities.csv" and str(files.kpi_path(db)) == "/d/italy-kpi.csv"
    assert str(files.cities_map_path(db, Path("name-roma.txt"))) == "/d/italy-name-roma.png"
