"""OSM PBF as a Spark data source: format "osmpbf", option entity = node, way or relation.

The driver reads the headers of the file's blobs and makes a partition of about ``blobs`` of
them; a task inflates and decodes its own, a record batch for each blob. A blob's kind of entity is
known only when it is inflated, so each of the three tables reads all of them. The format is the public OSM PBF specification:
protocol buffer messages of varints, zigzag numbers and delta lists.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "node": "node_id long, lon double, lat double, tags map<string,string>",
    "way": "way_id long, refs array<long>, tags map<string,string>",
    "relation": "relation_id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>",
}
KINDS = ("node", "way", "relation")
_TAGS = ("tags", pa.map_(pa.string(), pa.string()))
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = {
    "node": pa.schema([("node_id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), _TAGS]),
    "way": pa.schema([("way_id", pa.int64()), ("refs", pa.list_(pa.int64())), _TAGS]),
    "relation": pa.schema([("relation_id", pa.int64()), ("members", pa.list_(_MEMBER)), _TAGS]),
}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value = data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """A packed list of varints as unsigned 64-bit numbers, by array operations."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def inflate(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number == 4:
            return lzma.decompress(value)
        if number == 5:
            return bz2.decompress(value)
    raise ValueError("a blob without data that can be read")


def _tags(strings: list[str], keys: bytes, values: bytes) -> dict[str, str]:
    return {strings[k]: strings[v] for k, v in zip(packed(keys).tolist(), packed(values).tolist(), strict=True)}


def _dense(message: dict[int, bytes], strings: list[str], scale: tuple[int, int, int]) -> Iterator[tuple]:
    grain, lat0, lon0 = scale
    ids, lat, lon = (np.cumsum(zigzag(packed(message.get(k, b"")))) for k in (1, 8, 9))
    pairs, at = packed(message.get(10, b"")).tolist(), 0
    for i, y, x in zip(ids.tolist(), lat.tolist(), lon.tolist(), strict=True):
        tags = {}
        while at < len(pairs) and pairs[at]:
            tags[strings[pairs[at]]] = strings[pairs[at + 1]]
            at += 2
        at += 1
        yield i, 1e-9 * (lon0 + grain * x), 1e-9 * (lat0 + grain * y), tags


def entities(block: bytes, entity: str) -> Iterator[tuple]:
    """Rows of one primitive block."""
    strings: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for number, value in fields(block):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number == 19:
            lat0 = signed(value)
        elif number == 20:
            lon0 = signed(value)
    for group in groups:
        for number, value in fields(group):
            m = dict(fields(value)) if number in (1, 2, 3, 4) else {}
            if entity == "node" and number == 2:
                yield from _dense(m, strings, (grain, lat0, lon0))
            elif entity == "node" and number == 1:
                y, x = (int(zigzag(np.array([m[k]], np.uint64))[0]) for k in (8, 9))
                yield int(zigzag(np.array([m[1]], np.uint64))[0]), 1e-9 * (lon0 + grain * x), 1e-9 * (lat0 + grain * y), _tags(strings, m.get(2, b""), m.get(3, b""))
            elif entity == "way" and number == 3:
                yield signed(m[1]), np.cumsum(zigzag(packed(m.get(8, b"")))).tolist(), _tags(strings, m.get(2, b""), m.get(3, b""))
            elif entity == "relation" and number == 4:
                refs = np.cumsum(zigzag(packed(m.get(9, b"")))).tolist()
                members = [(KINDS[t], r, strings[s]) for t, r, s in zip(packed(m.get(10, b"")).tolist(), refs, packed(m.get(8, b"")).tolist(), strict=True)]
                yield signed(m[1]), members, _tags(strings, m.get(2, b""), m.get(3, b""))


class BlobRange(InputPartition):
    def __init__(self, blobs: list[tuple[int, int]]):
        self.blobs = blobs


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


class PbfReader(DataSourceReader):
    def __init__(self, path: str, entity: str, blobs: int):
        self.path, self.entity, self.blobs = path, entity, blobs

    def partitions(self) -> list[InputPartition]:
        found, at = [], 0
        with _open(self.path) as f:
            end = f.size()
            while at < end:
                head = int.from_bytes(f.read_at(4, at), "big")
                message = dict(fields(bytes(f.read_at(head, at + 4))))
                start = at + 4 + head
                if message[1] == b"OSMData":
                    found.append((start, message[3]))
                at = start + message[3]
        return [BlobRange(found[i : i + self.blobs]) for i in range(0, len(found), self.blobs)] or [BlobRange([])]

    def read(self, partition: BlobRange) -> Iterator[pa.RecordBatch]:
        schema = ARROW[self.entity]
        with _open(self.path) as f:
            for start, size in partition.blobs:
                rows = list(entities(inflate(bytes(f.read_at(size, start))), self.entity))
                if rows:
                    *columns, tags = zip(*rows, strict=True)
                    if self.entity == "relation":
                        columns[1] = [[dict(zip(("type", "ref", "role"), m, strict=True)) for m in members] for members in columns[1]]
                    columns.append([list(t.items()) for t in tags])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "node")]

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options["path"], self.options.get("entity", "node"), int(self.options.get("blobs", 16)))
