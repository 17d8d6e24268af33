"""A toy dump as XML text and as hand-encoded PBF."""

from __future__ import annotations

import zlib

NODES = {1: (7.0, 45.0), 2: (7.001, 45.0), 3: (7.002, 45.0), 10: (0.0, 0.0), 11: (4.0, 0.0), 12: (4.0, 4.0), 13: (0.0, 4.0), 20: (1.0, 1.0), 21: (2.0, 1.0), 22: (2.0, 2.0), 30: (7.5, 45.5)}
NODE_TAGS = {30: {"place": "square", "name": "Piazza Nodo"}}
WAYS = {
    100: ([1, 2, 999], {"highway": "residential", "name": "Via Roma"}),
    101: ([2, 3], {"highway": "service"}),
    102: ([3, 999], {"highway": "residential", "name": "Via Corta"}),
    103: ([3, 2], {"highway": "footway", "name": ""}),
    104: ([1, 3], {"waterway": "river", "name": "Po"}),
    200: ([10, 11, 12], {}),
    201: ([10, 13, 12], {}),
    202: ([20, 21, 22, 20], {"place": "square", "name": "Piazza Via"}),
}
RELATIONS = {
    300: ([("way", 200, "outer"), ("way", 201, "outer"), ("way", 202, "inner")], {"type": "boundary", "boundary": "administrative", "admin_level": "8", "name": "Paese", "ref:ISTAT": "001"}),
    301: ([("way", 200, "outer")], {"type": "boundary", "boundary": "administrative", "admin_level": "4", "name": "Aperta"}),
    302: ([("way", 202, "outer")], {"type": "boundary", "boundary": "administrative", "admin_level": "6", "name": "Provincia"}),
    303: ([("way", 202, "outer"), ("node", 1, "label")], {"type": "multipolygon", "place": "square", "name": "Piazza Relazione"}),
}


def xml() -> str:
    tags = lambda t: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t.items())
    out = ['<?xml version="1.0"?><osm version="0.6">']
    out += [f'<node id="{i}" lat="{y}" lon="{x}">{tags(NODE_TAGS.get(i, {}))}</node>' for i, (x, y) in NODES.items()]
    out += [f'<way id="{i}">{"".join(f"<nd ref={chr(34)}{r}{chr(34)}/>" for r in refs)}{tags(t)}</way>' for i, (refs, t) in WAYS.items()]
    out += [f'<relation id="{i}">{"".join(f"<member type={chr(34)}{k}{chr(34)} ref={chr(34)}{r}{chr(34)} role={chr(34)}{role}{chr(34)}/>" for k, r, role in m)}{tags(t)}</relation>' for i, (m, t) in RELATIONS.items()]
    return "\n".join([*out, "</osm>"])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _deltas(values: list[int]) -> bytes:
    return b"".join(_varint(_zig(b - a)) for a, b in zip([0, *values], values, strict=False))


def pbf() -> bytes:
    strings = [""]

    def at(s: str) -> int:
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    pack = lambda values: b"".join(map(_varint, values))
    pairs = []
    for i in NODES:
        for k, v in NODE_TAGS.get(i, {}).items():
            pairs += [at(k), at(v)]
        pairs.append(0)
    units = lambda k: [round(p[k] * 1e7) for p in NODES.values()]
    dense = _field(1, _deltas(list(NODES))) + _field(8, _deltas(units(1))) + _field(9, _deltas(units(0))) + _field(10, pack(pairs))
    ways = b"".join(_field(3, _field(1, i) + _field(2, pack(map(at, t))) + _field(3, pack(map(at, t.values()))) + _field(8, _deltas(refs))) for i, (refs, t) in WAYS.items())
    kinds = ("node", "way", "relation")
    relations = b"".join(_field(4, _field(1, i) + _field(2, pack(map(at, t))) + _field(3, pack(map(at, t.values()))) + _field(8, pack(at(r) for _, _, r in m)) + _field(9, _deltas([r for _, r, _ in m])) + _field(10, pack(kinds.index(k) for k, _, _ in m))) for i, (m, t) in RELATIONS.items())
    groups = [_field(2, dense), ways, relations]
    table = _field(1, b"".join(_field(1, s.encode()) for s in strings))

    def blob(kind: str, data: bytes, packed: bool) -> bytes:
        body = _field(2, len(data)) + _field(3, zlib.compress(data)) if packed else _field(1, data)
        head = _field(1, kind.encode()) + _field(3, len(body))
        return len(head).to_bytes(4, "big") + head + body

    return blob("OSMHeader", b"", False) + b"".join(blob("OSMData", table + _field(2, g), k != 1) for k, g in enumerate(groups))
