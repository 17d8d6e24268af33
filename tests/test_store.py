import pytest

from odonymy.functions.geo import Identity
from odonymy.store import Store
from odonymy.streaming import ingest


def way(i, name, *nodes):
    return (i, name, list(nodes), [{"node_id": n, "lon": float(n), "lat": 0.0} for n in nodes])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def test_replacing_a_table_that_is_read(store, spark):
    store.write("squares", spark.createDataFrame([(1, "a", 0.0, 0.0)], "osm_id long, name string, lon double, lat double"))
    store.write("squares", store.read("squares").union(store.read("squares")))
    assert store.read("squares").count() == 2 and store._versions("squares") == [2]
    assert store.read("areas").count() == 0


def test_meta(store):
    assert store.meta("parsed_count") is None
    store.set_meta(parsed_count=3, unnamed_count=1)
    store.set_meta(parsed_count=4, unnamed_count=None)
    assert (store.meta("parsed_count"), store.meta("unnamed_count")) == (4, None)


def test_following_files_upserts_and_resumes(store, spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    put = lambda *rows: spark.createDataFrame(rows, ingest.RAW).coalesce(1).write.mode("append").parquet(source)
    put(way(1, "Via A", 1, 2), way(2, None, 2, 3))
    ingest.follow_ways(spark, source, store, check)
    put(way(1, "Via B", 1, 2), way(3, "Via C", 5, 6))
    ingest.follow_ways(spark, source, store, check)
    ingest.follow_ways(spark, source, store, check)
    assert {r.way_id: r.name for r in store.read("ways").collect()} == {1: "Via B", 3: "Via C"}
    assert store.header() == {"parsed": 4, "unnamed": 1, "groups": 2}


def test_join_goes_on_with_unfinished_buckets(store, spark):
    rows = [way(i, f"Via N{i % 6}", 10 * i, 10 * i + 1) for i in range(12)]
    store.write("ways", ingest.named(spark.createDataFrame(rows, ingest.RAW)))
    assert ingest.join_in_buckets(store, 0.5, Identity(), buckets=3) == 12
    whole = sorted(map(tuple, store.read("streets").select("norm_name", "street_id").collect()))
    bucket = store.read("streets").selectExpr("pmod(xxhash64(norm_name), 3)").first()[0]
    part = f"{store.path}/streets_parts/of=3/bucket={bucket}"
    store.read("streets").limit(0).write.parquet(part)  # as if a run had been stopped after this bucket
    made = ingest.join_in_buckets(store, 0.5, Identity(), buckets=3)
    assert made < 12 and store.read("streets").count() == made and not store.has("streets_parts")
    assert ingest.join_in_buckets(store, 0.5, Identity(), buckets=1) == 12
    assert sorted(map(tuple, store.read("streets").select("norm_name", "street_id").collect())) == whole


def dump(spark, ids):
    nodes = spark.createDataFrame([(n, n / 1000, 45.0) for n in range(40)], "node_id long, lon double, lat double")
    rows = [(i, [k % 40, (k + 1) % 40], {"highway": "x", "name": f"Via {i}"} if i % 3 else {"highway": "x"}) for k, i in enumerate(ids)] + [(777, [1, 2], {"name": "no highway"})]
    return nodes, spark.createDataFrame(rows, "way_id long, refs array<long>, tags map<string,string>")


@pytest.mark.parametrize("steps", [1, 3, 50])
def test_extraction_in_steps_has_every_way_once(store, spark, steps):
    ids = [*range(-5, 12), 2**40]
    assert ingest.extract_in_steps(store, *dump(spark, ids), steps) == (18, sum(i % 3 == 0 for i in ids))
    assert sorted(r.way_id for r in store.read("ways").collect()) == [i for i in ids if i % 3] and store.parts("ways_parts") == []


def test_interrupted_extraction_goes_on_behind_its_cursor(store, spark, monkeypatch):
    nodes, ways = dump(spark, range(100))
    inner, seen = ingest.osm.highways, []

    def failing(nodes_, ways_, after, upto):
        seen.append((after, upto))
        if len(seen) == 3:
            raise RuntimeError("driver lost")
        return inner(nodes_, ways_, after, upto)

    monkeypatch.setattr(ingest.osm, "highways", failing)
    with pytest.raises(RuntimeError):
        ingest.extract_in_steps(store, nodes, ways, 4)
    done = max(map(int, store.parts("ways_parts")))
    assert store.read("ways").count() == 0 and 0 < done < 99
    assert ingest.extract_in_steps(store, nodes, ways, 2)[0] == 100
    assert seen[3][0] == done and store.read("ways").count() == sum(i % 3 != 0 for i in range(100))
    store.write("ways", store.read("ways").limit(0))
    assert ingest.extract_in_steps(store, nodes, ways, 2)[0] == 100 and seen[-2][0] is None  # a fresh run


def test_extraction_of_nothing(store, spark):
    nodes, ways = dump(spark, [])
    assert ingest.extract_in_steps(store, nodes, ways) == (0, 0) and store.read("ways").count() == 0


def test_last_row_of_an_id_wins(store, spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [way(1, name, 1, 2) for name in ("Via Z", "Via A", "Via M")]
    spark.createDataFrame(rows, ingest.RAW).coalesce(1).write.parquet(source)
    ingest.follow_ways(spark, source, store, str(tmp_path / "check"))
    assert [r.name for r in store.read("ways").collect()] == ["Via M"] and store.meta("parsed_count") == 3


def test_a_way_without_a_name_is_an_error(store, spark):
    rows = spark.createDataFrame([way(1, None, 1, 2)], ingest.RAW).selectExpr("*", "'x' AS norm_name")
    with pytest.raises(ValueError, match="without a name"):
        ingest.upsert(store, rows)
    assert store.read("ways").count() == 0


def test_views(store, spark):
    store.register_views()
    assert spark.sql("SELECT count(*) FROM street_groups").first()[0] == 0
