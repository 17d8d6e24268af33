"""Token ids in a grammar-compressed file format with random access.

Documents are dealt by ranges of doc_id (of one id: by the text's hash, of equal rows: by their
place), into at most ``most_parts`` parts, and lie in ascending order within a file; every
``shard_tokens`` ids or so form a shard with a grammar of its own, so memory and the work to
write or read a shard are bounded. The grammar is Re-Pair in rounds: all adjacent pairs of symbols
are counted by sorting, those at least a sixteenth as frequent as the most frequent one are
replaced by new symbols at once, and so on until no pair occurs ``min_count`` times. Where chosen
pairs overlap, every other one of the chain is taken.

A shard's row in the Parquet file: part and seq (its place in the order), the document ids and
their numbers of ids, the rules (pairs of symbols; symbols from ``base`` on are rules), the
number of ids each rule stands for, the symbols, and every 1024th symbol's position in ids.
``read_range`` decodes any range of ids: only the shards that hold some of it are read, and in
them only the symbols that do, and their rules, are expanded.

Defined cases: null and empty texts are the end id alone; repeated doc_ids stand side by side,
ordered by the text's hash; null doc_ids come first; an empty table gives no shards.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odonymy.llm.frames import text_bytes
from odonymy.llm.text import chunks, planes, unplanes
from odonymy.llm.tokens import encoder
from odonymy.session import scratch_path

STEP = 1024
TABLE_BITS, CHUNK = 20, 1 << 17
FILE = "part int, seq int, n_ids long, doc_ids binary, no_id binary, doc_sizes binary, base int, rules binary, rule_sizes binary, symbols binary, positions binary"


def compress(ids: np.ndarray, min_count: int = 8, share: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules as rows of two symbols, first rule's symbol)."""
    base = int(ids.max()) + 1 if len(ids) else 1
    # Worked on are dense numbers: the ids that occur, then the rules.
    freq = np.bincount(ids, minlength=base)
    names = np.flatnonzero(freq)
    freq, dense = freq[names], np.zeros(base, np.uint32)
    dense[names] = np.arange(len(names))
    seq = dense[ids]
    rules: list[np.ndarray] = []
    while len(seq) > 1:
        wide = len(freq)
        if wide < 1 << 16:
            kind, part, back = np.uint32, seq, np.arange(wide)
        else:
            # A pair is never more frequent than its symbols: the rare ones share a number, whose pairs don't count.
            back = np.concatenate([[-1], np.flatnonzero(freq >= min_count)])
            rank = np.zeros(wide, np.uint32)
            rank[back[1:]] = np.arange(1, len(back))
            part, wide = rank[seq], len(back)
            kind = np.uint32 if wide < 1 << 16 else np.uint64
        pair = part[:-1] * kind(wide) + part[1:].astype(kind, copy=False)
        count, every = _frequent(pair if back[0] >= 0 else pair[(part[:-1] > 0) & (part[1:] > 0)], min_count, share)
        if not len(count):
            break
        chosen = every[count >= max(min_count, int(count.max()) // share)]
        at, rule, chosen = _places(pair, chosen)
        # In a chain of overlapping pairs the 1st, 3rd, 5th ... are taken.
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        chain = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        odd = (chain & 1) == 0
        at, rule = at[odd], rule[odd]
        two = np.stack([back[chosen // kind(wide)], back[chosen % kind(wide)]], 1)
        seq[at] = rule + len(freq)
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq = seq[left]
        made = np.bincount(rule, minlength=len(chosen))
        np.subtract.at(freq, two, made[:, None])
        freq = np.concatenate([freq, made])
        rules.append(two)
    symbol = np.concatenate([names, base + np.arange(len(freq) - len(names))]).astype(np.int32)
    return symbol[seq], symbol[np.concatenate(rules)] if rules else np.zeros((0, 2), np.int32), base


def _frequent(pair: np.ndarray, min_count: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, pairs) of all pairs that occur ``min_count`` times and a ``share``-th as often as the most frequent one, and of some rarer ones.

    A pair that fills r places in a row of every 64th of the sorted pairs occurs more than 64 * (r - 1) times; that
    bounds the count from below that matters, and only pairs equal to the one so many places on are looked at.
    """
    ordered = np.sort(pair)
    some = ordered[::64]
    ends = np.flatnonzero(np.append(some[1:] != some[:-1], True)) if len(some) else np.zeros(1, np.int64)
    least = max(min_count, 64 * (int(np.diff(ends, prepend=-1).max()) - 1) // share)
    n = max(0, len(ordered) - least + 1)
    near = np.flatnonzero(ordered[least - 1 : least - 1 + n] == ordered[:n])
    found = ordered[near]
    head = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    return np.diff(head, append=len(found)) + least - 1, found[head]


def _places(pair: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of chosen pairs, number of each one's pair, the chosen pairs).

    Chosen pairs stand in a table by hash; one whose place is taken is left out and waits for the next round.
    """
    kind, bits = pair.dtype.type, 8 * pair.itemsize
    slot = lambda x: (x * kind(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> kind(bits - TABLE_BITS)
    # A byte for each place stays in the cache; the tables are looked at where it is set only.
    table, number, taken = np.empty(1 << TABLE_BITS, kind), np.empty(1 << TABLE_BITS, np.int32), np.zeros(1 << TABLE_BITS, bool)
    table[slot(chosen)] = chosen
    chosen = chosen[table[slot(chosen)] == chosen]
    number[slot(chosen)] = np.arange(len(chosen))
    taken[slot(chosen)] = True
    found = []
    for start in range(0, len(pair), CHUNK):  # small pieces stay in the cache
        some = pair[start : start + CHUNK]
        place = slot(some).astype(np.intp)
        hit = np.flatnonzero(taken.take(place, mode="clip"))
        place = place[hit]
        same = table[place] == some[hit]
        found.append((hit[same] + start, number[place[same]]))
    at, rule = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    return at, rule, chosen


def rule_sizes(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids of each rule; a rule uses ids and earlier rules only."""
    size = np.zeros(len(rules), np.int64)
    for i, (a, b) in enumerate((rules - base).tolist()):
        size[i] = (size[a] if a >= 0 else 1) + (size[b] if b >= 0 else 1)
    return size


class Grammar:
    """Decodes a shard's symbols, all or any range of its ids."""

    def __init__(self, row: dict):
        self.symbols, self.base = unplanes(row["symbols"], np.int32), row["base"]
        self.rules = unplanes(row["rules"], np.int32).reshape(-1, 2)
        self.sizes, self.positions, self.n_ids = unplanes(row["rule_sizes"], np.int64), unplanes(row["positions"], np.int64), row["n_ids"]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of the symbols; no other rules than theirs are looked at."""
        out = symbols
        while len(rule := np.flatnonzero(out >= self.base)):
            width = np.ones(len(out), np.int64)
            width[rule] = 2
            at = np.cumsum(width) - width
            new = np.empty(len(out) + len(rule), out.dtype)
            new[at] = out
            new[at[rule]], new[at[rule] + 1] = self.rules[out[rule] - self.base].T
            out = new
        return out.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """Ids of the whole shard; each rule is expanded once."""
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), self.expand(np.arange(len(self.rules), dtype=np.int32) + self.base)])
        size = np.concatenate([np.ones(self.base, np.int64), self.sizes])
        first = np.cumsum(size) - size
        n = size[self.symbols]
        shift = (first[self.symbols] - np.cumsum(n) + n).astype(np.int32)  # a shard has fewer than 2**31 ids
        return flat[np.repeat(shift, n) + np.arange(self.n_ids, dtype=np.int32)]

    def read_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard, from the symbols that hold them."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        lo = int(np.searchsorted(self.positions, start, "right")) - 1
        hi = int(np.searchsorted(self.positions, stop, "left"))
        some = self.symbols[lo * STEP : hi * STEP]
        # Of these at most two steps of symbols the lengths tell which ones hold the range.
        end = self.positions[lo] + np.cumsum(np.where(some >= self.base, self.sizes[np.maximum(some - self.base, 0)] if len(self.sizes) else 1, 1))
        a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
        skip = start - (int(end[a - 1]) if a else int(self.positions[lo]))
        return self.expand(some[a:b])[skip : skip + stop - start]


def _shard(part: int, seq: int, docs: list, sizes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    every = np.concatenate(ids)
    symbols, rules, base = compress(every)
    size = rule_sizes(rules, base)
    per = np.concatenate([np.ones(base, np.int64), size])[symbols]
    positions = (np.cumsum(per) - per)[::STEP]
    row = {"part": np.int32(part), "seq": np.int32(seq), "n_ids": len(every), "doc_ids": planes(np.array([d or 0 for d in docs], np.int64)), "no_id": np.array([d is None for d in docs]).tobytes(), "doc_sizes": planes(np.concatenate(sizes)), "base": base, "rules": planes(rules), "rule_sizes": planes(size), "symbols": planes(symbols), "positions": planes(positions)}
    types = {"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "base": pa.int32()}
    return pa.record_batch({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})


def write(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = 2_000_000, part_bytes: int = 24 << 20, most_parts: int = 20_000) -> None:
    """Encodes every document and writes the shards under ``path``.

    Range bounds come from a sample of keys that Spark takes by itself, at most a few million.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, sizes, names, n, seq = [], [], [], 0, 0
        for p in chunks(batches, limit=1 << 20):
            got, bounds = encode(p.column("text").to_pylist())
            ids.append(got)
            sizes.append(np.diff(bounds))
            names += p.column("doc_id").to_pylist()
            n += len(got)
            if n >= shard_tokens:
                yield _shard(part, seq, names, sizes, ids)
                ids, sizes, names, n, seq = [], [], [], 0, seq + 1
        if names:
            yield _shard(part, seq, names, sizes, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    parts = min(most_parts, max(8, -(-text_bytes(docs) // part_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, FILE).write.parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """part, seq, n_ids and start, the number of ids before each shard; of parts there are at most ``most_parts``."""
    sizes = files.select("part", "seq", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("b"))
    within = sizes.select("part", "seq", "n_ids", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("w"))
    return within.join(before, "part").select("part", "seq", "n_ids", (F.col("b") + F.col("w")).alias("start"))


def read_range(files: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of the whole file, in order; the result is in the driver's memory."""
    held = shard_starts(files).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()
    if not held or stop <= start:
        return np.zeros(0, np.uint32)
    first = {(r.part, r.seq): r.start for r in held}
    some = files.where(functools.reduce(lambda a, b: a | b, ((F.col("part") == p) & (F.col("seq") == q) for p, q in first)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = first[row["part"], row["seq"]]
                ids = Grammar(row).read_range(start - at, stop - at)
                yield pa.record_batch({"start": pa.array([at]), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    got = sorted(some.mapInArrow(run, "start long, ids binary").collect())
    return np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])


def read(files: DataFrame) -> DataFrame:
    """Decodes the files: per document doc_id, start (ids before it), n_tokens, ids_crc32."""
    starts = shard_starts(files).select("part", "seq", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Grammar(row).all_ids().astype("<u4")
                names, none = unplanes(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], bool)
                n = unplanes(row["doc_sizes"], np.int64)
                end = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                yield pa.record_batch([pa.array(names, mask=none), pa.array(row["start"] + end - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["part", "seq"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write(docs, tokenizer, path)
    return read(spark.read.parquet(path))
