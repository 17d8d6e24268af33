import bz2
import gzip

import numpy as np
import osm_files
import pytest

from odonymy.sources import osm, pbf


@pytest.fixture(scope="module", params=["osm", "osm.gz", "osm.bz2", "osm.pbf"])
def dump(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / f"toy.{request.param}"
    text = osm_files.xml().encode()
    path.write_bytes({"osm": lambda: text, "osm.gz": lambda: gzip.compress(text), "osm.bz2": lambda: bz2.compress(text), "osm.pbf": osm_files.pbf}[request.param]())
    return osm.read(spark, str(path))


def test_entities(dump):
    assert {r.node_id: (round(r.lon, 7), round(r.lat, 7)) for r in dump.nodes.collect()} == osm_files.NODES
    assert {r.way_id: (r.refs, r.tags) for r in dump.ways.collect()} == osm_files.WAYS
    assert {r.relation_id: ([tuple(m) for m in r.members], r.tags) for r in dump.relations.collect()} == osm_files.RELATIONS


def test_highways_keep_all_refs_and_located_coords(dump):
    got = {r.way_id: r for r in osm.highways(dump.nodes, dump.ways).collect()}
    assert sorted(got) == [100, 101, 103]
    assert got[100].node_ids == [1, 2, 999] and [c.node_id for c in got[100].coords] == [1, 2]
    assert (got[100].name, got[100].norm_name, got[101].name, got[103].name, got[103].norm_name) == ("Via Roma", "roma", None, "", "")
    assert [c.node_id for c in got[103].coords] == [3, 2]
    assert {r.way_id for r in osm.highways(dump.nodes, dump.ways, after=100).collect()} == {101, 103}


def test_areas_assemble_rings_with_holes(dump):
    got = osm.admin_areas(dump).collect()
    assert [(r.osm_id, r.admin_level, r.name, r.istat, r.from_way) for r in got] == [(300, "8", "Paese", "001", False)]
    (outer, hole), = got[0].geometry
    assert {(round(p.x), round(p.y)) for p in outer} == {(0, 0), (4, 0), (4, 4), (0, 4)} and outer[0] == outer[-1]
    assert {(round(p.x), round(p.y)) for p in hole} == {(1, 1), (2, 1), (2, 2)}


def test_squares_from_node_way_and_relation(dump):
    got = {r.name: (r.osm_id, r.lon, r.lat) for r in osm.squares(dump).collect()}
    assert set(got) == {"Piazza Nodo", "Piazza Via", "Piazza Relazione"}
    assert got["Piazza Nodo"] == (30, pytest.approx(7.5), pytest.approx(45.5))
    for name in ("Piazza Via", "Piazza Relazione"):
        _, x, y = got[name]
        assert 1 < y < 2 and y < x + 1e-9 and x < 2


def test_formats(tmp_path):
    assert [osm.detect_format(f"/a/{n}") for n in ("x.OSM.PBF", "x.osm.bz2", "x.pbf", "x.gz")] == [".osm.pbf", ".osm.bz2", ".pbf", None]
    with pytest.raises(osm.MissingInput):
        osm.validate_input(str(tmp_path / "no.osm"))
    (tmp_path / "x.csv").write_text("")
    with pytest.raises(osm.UnsupportedFormat, match=".osm.bz2, .osm.gz"):
        osm.validate_input(str(tmp_path / "x.csv"))


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**40, 2**63 - 1]
    data = b"".join(osm_files._varint(v) for v in values)
    assert pbf.packed(data).tolist() == values
    signed = [0, -1, 1, -(2**62), 2**62]
    assert pbf.zigzag(np.array([osm_files._zig(v) for v in signed], np.uint64)).tolist() == signed


def test_stitching():
    line = lambda *ids: [(i, float(i % 3), float(i // 3)) for i in ids]
    assert len(osm.stitch([line(0, 1, 4), line(0, 3, 4)])) == 1
    assert osm.stitch([line(0, 1, 4), line(4, 5)]) is None
    assert osm.stitch([]) == []
