import random

import pytest

from odonymy import catalog
from odonymy.functions.geo import Identity
from odonymy.operators import streets
from odonymy.plans.graph import connected_components
from odonymy.streaming.ingest import named

WAYS = "way_id long, name string, node_ids array<long>, coords array<struct<node_id:long,lon:double,lat:double>>"


@pytest.fixture(scope="module")
def ways(spark):
    def build(rows):
        """rows: (id, name, node ids, points); coords belong to the nodes in order."""
        flat = [(i, n, nodes, [{"node_id": k, "lon": float(x), "lat": float(y)} for k, (x, y) in zip(nodes, points, strict=False)]) for i, n, nodes, points in rows]
        return named(spark.createDataFrame(flat, WAYS))

    return build


def classes(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.component, set()).add(r.way_id)
    return sorted(map(sorted, found.values()))


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    edges = [(a, b) for a, b in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45))] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 3)]
    label = {}

    def find(v):
        label.setdefault(v, v)
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            label[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in label}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_nodes_join_within_a_name_only(ways):
    w = ways([(1, "Via Roma", [1, 2], []), (2, "VIA ROMA", [2, 3], []), (3, "Via Milano", [3, 4], []), (4, "Piazza Roma", [9, 9], [])])
    assert classes(streets.components(w)) == [[1, 2], [3], [4]]


def test_distance_joins_at_the_threshold_and_chains(ways):
    w = ways([(1, "Via A", [1, 2], [(0, 0), (10, 0)]), (2, "Via A", [3, 4], [(110, 0), (120, 0)]), (3, "Via A", [5, 6], [(221, 0), (300, 0)]), (4, "Via B", [7, 8], [(0, 1), (10, 1)]), (5, "Via A", [20], [(5, 0)])])
    assert classes(streets.components(w, 100.0, Identity())) == [[1, 2], [3], [4], [5]]
    assert classes(streets.components(w, 101.0, Identity())) == [[1, 2, 3], [4], [5]]


def test_crossing_and_degenerate_lines(ways):
    w = ways([(1, "Via X", [1, 2], [(0, 0), (100, 100)]), (2, "Via X", [3, 4], [(0, 100), (100, 0)]), (3, "Via X", [5, 6], [(50, 55), (50, 55)]), (4, "Via X", [7, 8], [(500, 0), (90000, 0)])])
    assert classes(streets.components(w, 5.0, Identity())) == [[1, 2, 3], [4]]


def test_long_lines_meet_far_from_their_ends(ways):
    w = ways([(1, "Via L", [1, 2], [(0, 0), (100000, 50000)]), (2, "Via L", [3, 4], [(50000, 25040), (50001, 25060)])])
    assert classes(streets.components(w, 50.0, Identity())) == [[1, 2]]
    assert classes(streets.components(w, 30.0, Identity())) == [[1], [2]]


def test_distances_equal_brute_force(ways):
    from test_geo import gap

    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rng.randint(0, 900), rng.randint(0, 900)
        rows.append((i, "Via Z", [1000 + 2 * i, 1001 + 2 * i], [(x, y), (x + rng.randint(-90, 90), y + rng.randint(-90, 90))]))
    want = sorted((a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if gap(a[3], b[3]) <= 60.5)
    got = sorted((r.a, r.b) for r in streets.distance_edges(ways(rows), 60.5, Identity()).collect())
    assert got == want


def test_streets_groups_and_display_names(ways):
    w = ways([(1, "Via Roma", [1, 2], []), (2, "Viale Roma", [2, 3], []), (3, "Viale Roma", [8, 9], []), (4, "Via Milano", [4], []), (5, "Corso Milano", [5], [])])
    made = streets.streets(streets.components(w))
    assert sorted((r.norm_name, r.name, r.way_ids) for r in made.collect()) == [("milano", "Corso Milano", [4]), ("milano", "Corso Milano", [5]), ("roma", "Viale Roma", [1, 2]), ("roma", "Viale Roma", [3])]
    top = streets.top_groups(streets.street_groups(made), 1).collect()
    assert [(r.norm_name, r["count"]) for r in top] == [("milano", 2)]


def shape(extra=()):
    """Three segments that join through nodes 500 and 501 and by distance, near Turin."""
    rows = [(1, "Via Prova", [500, 100], [(7.0, 45.0), (7.0, 45.0006)]), (2, "Via Prova", [500, 501], [(7.0009, 45.0), (7.0009, 45.0006)]), (3, "Via Prova", [501, 300], [(7.0018, 45.0), (7.0018, 45.0006)])]
    return rows + list(extra)


def test_no_near_miss_within_one_street(ways):
    assert streets.near_misses(ways(shape()), 100.0).count() == 0


def test_near_miss_names_street_way_and_node(ways):
    got = streets.near_misses(ways(shape([(4, "Via Prova", [900, 901], [(7.0034, 45.0), (7.0034, 45.0006)])])), 100.0).collect()
    assert [(r.street_id_a, r.street_id_b, r.way_id_a, r.way_id_b) for r in got] == [(1, 4, 3, 4)]
    assert got[0].node_id_a in (501, 300) and got[0].node_id_b in (900, 901)
    assert got[0].distance_m == pytest.approx(126.2, abs=0.5) and got[0].name == "Via Prova"


def test_band_is_closed_below_and_open_above(ways):
    w = ways([(1, "Via B", [1, 2], [(0, 0), (10, 0)]), (2, "Via B", [3, 4], [(0, 100), (10, 100)]), (3, "Via B", [5, 6], [(0, 299.5), (10, 299.5)]), (4, "Via B", [7, 8], [(0, 500), (10, 500)])])
    got = streets.near_misses(w, 100.0, Identity()).collect()
    assert [(r.street_id_a, r.street_id_b, r.distance_m) for r in got] == [(1, 3, 199.5)]


def test_ways_that_cannot_be_measured_join_by_nodes_only(ways):
    nan, inf = float("nan"), float("inf")
    w = ways([(1, "Via B", [1, 2], [(0, 0), (10, 0)]), (2, "Via B", [2, 3], [(nan, 0), (10, 1)]), (3, "Via B", [4, 5], [(0, 1), (inf, 1)]), (4, "Via B", [6, 7], [(0, 2), (10, 2)])])
    assert sorted(r.way_id for r in streets.unmeasurable(w).collect()) == [2, 3]
    assert {r.way_id: r.component for r in streets.components(w, 5.0, Identity()).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert streets.near_misses(w, 1.5, Identity()).select("street_id_a", "street_id_b").collect() == [(1, 4)]


def in_one_place(n):
    """n ways of 10 m within 40 m, and one 150 m away."""
    rng = random.Random(3)
    at = [(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(n)] + [(180, 15)]
    return [(i, "Via B", [2 * i, 2 * i + 1], [(x, y), (x + 7, y + 7)]) for i, (x, y) in enumerate(at, 1)]


def written(monkeypatch, module, name):
    """Collects the number of rows of each intermediate table of that name that the module writes."""
    seen, write = [], module.materialize

    def spy(df, at, *more):
        out = write(df, at, *more)
        if at == name:
            seen.append(out.count())
        return out

    monkeypatch.setattr(module, "materialize", spy)
    return seen


def test_near_misses_of_a_dense_place_list_no_pairs_within_a_street(ways, monkeypatch):
    gaps = written(monkeypatch, streets, "way-gaps")
    got = streets.near_misses(ways(in_one_place(120)), 100.0, Identity()).collect()
    assert [(r.street_id_a, r.street_id_b, r.way_id_b) for r in got] == [(1, 121, 121)]
    assert len(gaps) == 1 and gaps[0] <= 120  # of 120 * 119 / 2 pairs within the street, none


@pytest.mark.parametrize("name", ["near_miss_details", "pair_lines"])
def test_reports_of_a_dense_place_list_no_pairs_within_a_street(compare, spark, tmp_path, monkeypatch, name):
    here = [199 * 211 * 100 * k for k in range(1, 121)]  # one place, one group
    near = next(o for o in range(100, 10**8, 100) if o * 7919 % 199 == 4 and o * 104729 % 211 == 0)
    far = next(o for o in range(100, 10**8, 100) if o * 7919 % 199 == 100 and o * 104729 % 211 == 100)
    orders = [*here, near, far]
    spark.createDataFrame([(o, 100) for o in orders], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = [(o, 2 * (i % 3) + 202 * k, k) for i, o in enumerate(orders) for k in range(2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    gaps = written(monkeypatch, streets, "way-gaps")
    compare(catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert len(gaps) == 1 and 0 < gaps[0] <= 120  # of 120 * 119 / 2 pairs within the street, none


def test_near_miss_of_ways_with_many_nodes_keeps_few_rows(ways, monkeypatch):
    lines, ends = (written(monkeypatch, streets, name) for name in ("near-lines", "gap-ends"))
    low, high = [(5 * k, 0) for k in range(200)], [(5 * k, 150 + abs(k - 77)) for k in range(200)]
    got = streets.near_misses(ways([(1, "Via A", list(range(200)), low), (2, "Via A", list(range(1000, 1200)), high)]), 100.0, Identity()).collect()
    assert [(r.node_id_a, r.node_id_b, r.distance_m) for r in got] == [(77, 1077, 150.0)]
    assert lines == [50]  # a row for eight segments, not one for each
    assert len(ends) == 1 and ends[0] <= 4  # of 199 * 199 pairs of segments


@pytest.mark.parametrize("name", ["near_miss_details", "pair_lines"])
def test_reports_of_ways_with_many_nodes_keep_few_rows(compare, spark, tmp_path, monkeypatch, name):
    here = 199 * 211 * 100
    near = next(o for o in range(100, 10**8, 100) if o * 7919 % 199 == 5 and o * 104729 % 211 == 0)
    spark.createDataFrame([(o, 100) for o in (here, near)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = [(o, 7 * k + i, k) for i, o in enumerate((here, near)) for k in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    ends = written(monkeypatch, streets, "gap-ends")
    compare(catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert len(ends) == 1 and 0 < ends[0] <= 40  # of 39 * 39 pairs of segments


def test_near_misses_equal_brute_force_on_odd_rows(spark, ways):
    rng = random.Random(11)
    rows = []
    for i in range(1, 161):
        x, y = (rng.uniform(0, 60), rng.uniform(0, 60)) if i % 3 else (rng.uniform(-900, 900), rng.uniform(-900, 900))
        reach = 4000.0 if i % 40 == 0 else 25.0  # a few longer than the raster takes
        points = [(round(x + rng.uniform(-reach, reach), 3), round(y + rng.uniform(-reach, reach), 3)) for _ in range(rng.choice((1, 2, 2, 3, 4)))]
        rows.append((i, f"Via {'AB'[i % 2]}", [10 * i + k if k or i % 25 else 7 for k in range(len(points))], points))
    rows.append((5, rows[4][1], [9001, 9002], [(700.0, 20.0), (712.0, 20.0)]))  # a repeated id, elsewhere
    w = ways(rows)

    def point_segment(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2

    def gap(s, t):
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        found = []
        for a, b in zip(s, s[1:], strict=False):
            for c, d in zip(t, t[1:], strict=False):
                if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                    return 0.0
                found += [point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b)]
        return min(found) ** 0.5

    for threshold in (12.0, 60.0):
        label = {r[0]: r[0] for r in rows}

        def find(v, label=label):
            while label[v] != v:
                v = label[v]
            return v

        near = [(a, b, gap(s, t)) for a, n, _, s in rows for b, m, _, t in rows if a < b and n == m and len(s) > 1 and len(t) > 1]
        shared = [(a, b) for a, n, u, _ in rows for b, m, v, _ in rows if a < b and n == m and set(u) & set(v)]
        for a, b in [(a, b) for a, b, d in near if d <= threshold] + shared:
            label[max(find(a), find(b))] = min(find(a), find(b))
        assert {r.way_id: r.component for r in streets.components(w, threshold, Identity()).collect()} == {v: find(v) for v in label}
        least, want = {}, {}
        for i, _, _, points in rows:
            if len(points) > 1:
                least[find(i)] = min(i, least.get(find(i), i))
        for a, b, d in near:
            key = tuple(sorted((least[find(a)], least[find(b)])))
            if key[0] != key[1]:
                want[key] = min(d, want.get(key, d))
        want = {k: round(d, 6) for k, d in want.items() if threshold <= d < 2 * threshold}
        assert {(r.street_id_a, r.street_id_b): round(r.distance_m, 6) for r in streets.near_misses(w, threshold, Identity()).collect()} == want


def test_null_names_never_meet_on_the_raster(spark):
    rows = [(i, None, None, [i], [{"node_id": i, "lon": 0.0, "lat": 0.0}, {"node_id": i + 10, "lon": 5.0, "lat": float(i)}]) for i in (1, 2)]
    w = spark.createDataFrame(rows, "way_id long, name string, norm_name string, node_ids array<long>, coords array<struct<node_id:long,lon:double,lat:double>>")
    assert {r.way_id: r.component for r in streets.components(w, 50.0, Identity()).collect()} == {1: 1, 2: 2}


def test_streets_of_a_dense_place_are_joined_without_listing_its_pairs(ways, monkeypatch):
    from odonymy.plans import graph

    edges = written(monkeypatch, graph, "edges")
    assert classes(streets.components(ways(in_one_place(120)), 100.0, Identity())) == [list(range(1, 121)), [121]]
    assert max(edges) <= 120  # not 120 * 119 / 2


def folders(spark):
    from pathlib import Path

    from odonymy.session import scratch_root

    return {p.name for p in Path(scratch_root(spark).removeprefix("file:")).iterdir()}


@pytest.mark.parametrize("size", [None, 1])
def test_pair_lines_leaves_no_tables_behind_in_one_part_or_four(compare, spark, monkeypatch, size):
    from odonymy import session

    if size:
        monkeypatch.setattr(session, "PART", size)
    before = folders(spark)
    compare(catalog.QUERIES["pair_lines"], catalog.ORACLES["pair_lines"])
    assert folders(spark) == before


def test_parts_of_a_table_are_all_its_rows_and_keep_a_key_together(spark):
    from odonymy.session import discard, materialize, split

    rows = [(f"g{i % 9}" if i % 10 else None, i) for i in range(200)]
    table = spark.createDataFrame(rows, "norm_name string, way_id long")
    parts = [[tuple(r) for r in part.collect()] for part in split(table, 4)]
    assert len(parts) == 4 and sorted(r[1] for part in parts for r in part) == list(range(200))
    assert all(sum(any(r[0] == name for r in part) for part in parts) == 1 for name in {n for n, _ in rows})
    whole = materialize(split(table, 4), "parts-test")
    assert sorted(tuple(r)[1] for r in whole.collect()) == list(range(200)) and whole.schema == table.schema
    discard(whole)
