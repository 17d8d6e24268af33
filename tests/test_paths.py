from odonymy import paths
from odonymy.sources import config_files as files


def test_names_of_local_paths_and_uris():
    assert files.store_path("s3a://bucket/x/italy.osm.pbf") == "s3a://bucket/x/italy.db"
    assert files.alias_path("italy.db") == "aliases.txt" and files.kpi_path("s3a://b/italy.db") == "s3a://b/italy-kpi.csv"
    assert (paths.stem_of("/a/.hidden"), paths.stem_of("a.b.txt"), paths.stem_of("x")) == (".hidden", "a.b", "x")
    assert paths.is_uri("hdfs://h/x") and not paths.is_uri("/a/b")


def test_text_through_a_uri(spark, tmp_path):
    at = f"file://{tmp_path}/some/names.txt"
    assert not paths.is_file(at, spark)
    paths.write_text(at, "Via Ré\n%\n", spark)
    assert paths.is_file(at, spark) and paths.read_text(at, spark) == "Via Ré\n%\n"
    assert not paths.is_file(f"file://{tmp_path}/some", spark)
    assert files.parse_patterns(at).includes == ["Via Ré", "%"]
    assert paths.read_text(str(tmp_path / "some" / "names.txt")) == "Via Ré\n%\n"
