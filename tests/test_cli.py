import io
import shutil

import osm_files
import pytest

from odonymy import cli, sinks
from odonymy.reporter import Reporter
from odonymy.store import Store


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A store after extract, areas and join."""
    folder = tmp_path_factory.mktemp("cli")
    (folder / "toy.osm.pbf").write_bytes(osm_files.pbf())
    for argv in (["extract", str(folder / "toy.osm.pbf")], ["areas", str(folder / "toy.osm.pbf")], ["join", str(folder / "toy.db")]):
        assert cli.main(argv, spark) == 0
    return folder


@pytest.fixture
def run(made, spark, tmp_path, capsys):
    folder = tmp_path / "c"
    shutil.copytree(made, folder)

    def go(*argv):
        capsys.readouterr()
        code = cli.main([str(a) for a in argv], spark)
        seen = capsys.readouterr()
        return code, seen.out, seen.err

    return go, folder


def test_extract_counts(made, spark):
    store = Store(spark, str(made / "toy.db"))
    assert store.header() == {"parsed": 3, "unnamed": 1, "groups": 2}
    assert store.read("squares").count() == 3 and store.read("areas").count() == 1


def test_join_prints_groups_and_is_repeatable(run):
    go, folder = run
    code, out, err = go("join", folder / "toy.db", "-t", "50")
    assert code == 0 and out.splitlines() == ["count\tnorm_name\tname", "1\t\t", "1\troma\tVia Roma"]
    assert "parsed=3 groups=2 streets=2" in err


def test_threshold_prints_nothing_without_pairs(run):
    go, folder = run
    assert go("threshold", folder / "toy.db")[:2] == (0, "")


def test_prefixes(run):
    go, folder = run
    code, out, err = go("prefixes", folder / "toy.osm.pbf")
    assert (code, out) == (0, "") and "0 words" in err


def test_map_warns_about_unknown_targets_and_sparse_cells(run):
    go, folder = run
    code, _, err = go("map", folder / "toy.db", "nowhere")
    assert code == 1 and "no street has the key" in err and "no cell has 42 streets" in err
    code, _, err = go("map", folder / "toy.db", "roma", "--min-streets", "1", "-o", folder / "m.png")
    assert code == 0 and (folder / "m.svg").exists()


def test_kpi_without_regions_warns(run):
    go, folder = run
    code, _, err = go("kpi", folder / "toy.db", "-n", "0")
    assert code == 1 and "no region boundaries" in err
    assert (folder / "toy-kpi.csv").read_text().splitlines()[1].startswith("roma,1,7.000500,45.000000,0.000,,,,,,0.0000") or "roma,1,7.000500,45.000000" in (folder / "toy-kpi.csv").read_text()


def test_alias_relabels_and_reports_unknown_variants(run, spark):
    go, folder = run
    (folder / "aliases.txt").write_text("roma=urbe\nghost=urbe\n")
    code, out, err = go("alias", folder / "toy.db")
    assert code == 1 and out.splitlines() == ["1 - roma", "0 - ghost", "total: 1"] and "ghost" in err
    assert {r.norm_name for r in Store(spark, str(folder / "toy.db")).read("street_groups").collect()} == {"urbe", ""}


def test_bad_alias_file_changes_nothing(run, spark):
    go, folder = run
    (folder / "aliases.txt").write_text("roma=a\na=b\n")
    code, out, err = go("alias", folder / "toy.db")
    assert (code, out) == (1, "") and "a" in err
    assert {r.norm_name for r in Store(spark, str(folder / "toy.db")).read("streets").collect()} == {"roma", ""}


def test_cities(run):
    go, folder = run
    (folder / "name-via.txt").write_text("Piazza V%\n")
    code, _, err = go("cities", folder / "toy.db", folder / "name-via.txt", "-m")
    assert code == 0 and "1 of 1" in err or "0 of 1" in err
    assert (folder / "toy-cities.csv").read_text().startswith("name,postal_code,istat,catasto,wikidata,osm_id,name-via\nPaese,,001,,,relation/300,")
    assert (folder / "toy-name-via.svg").exists()
    assert go("cities", folder / "toy.db", folder / "name-via.txt", "-r", "77")[0] == 1
    assert go("cities", folder / "none.db", folder / "name-via.txt")[0] == 1
    (folder / "empty.txt").write_text("# nothing\n")
    assert go("cities", folder / "toy.db", folder / "empty.txt")[0] == 1


def test_input_errors(run):
    go, folder = run
    assert go("extract", folder / "missing.osm")[0] == 1
    (folder / "x.csv").write_text("")
    assert go("areas", folder / "x.csv")[0] == 1


def test_arguments():
    parse = cli.parser().parse_args
    assert parse(["join", "a.db"]).threshold == 100.0
    assert (parse(["map", "a.db", "roma"]).cell, parse(["map", "a.db", "roma"]).min_streets) == (10.0, 42)
    assert parse(["kpi", "a.db"]).min_count == 20
    assert parse(["extract", "x.osm", "p.db", "-d", "q.db", "-vv"]).verbosity == 2


def test_kpi_csv_rounds_half_to_even_and_quotes():
    from pyspark.sql import Row

    row = Row(norm_name='a,"b', count=3, mean_lon=7.0, mean_lat=45.5, std_distance_km=0.0625, top_region=None, top_region_lq=None, top_region_share=None, effective_regions=None, region_gini=None, skew_score=0.5)
    out = io.StringIO()
    assert sinks.write_kpis([row], out) == 1
    assert out.getvalue().splitlines()[1] == '"a,""b",3,7.000000,45.500000,0.062,,,,,,0.5000'
    assert sinks.write_kpis([], io.StringIO()) == 0


def test_reporter():
    out = io.StringIO()
    say = Reporter(out, 1)
    say.info("i")
    say.debug("d")
    say.set_counts(parsed=3)
    say.summary()
    assert out.getvalue() == "info: i\nsummary: parsed=3 groups=n/a streets=n/a\n" and say.exit_code == 0
    say.warn("w")
    assert say.exit_code == 1
