"""Packing of documents into sequences of fixed length by swap-based local search.

Each text is encoded whole, ended by id 0 and, only if longer than a sequence, cut into full
pieces. Full pieces are sequences of their own. The others are dealt evenly into shards of
about ``shard_tokens`` tokens (thousands of sequences) and each shard is packed by itself:
pieces go in the order they come into the fullest bin they fit, and a local search then takes
documents out of the emptiest of the underfull bins until bins fall empty and are dropped. Its
steps, in the order they are tried: moving a piece into another bin, exchanging one piece for a
smaller one, or two pieces for a smaller one (first such that fill the receiving bin to the brim,
then any), and one piece for two that are smaller together. The receiving bin is at least as full and grows, so the sum of squared fills
rises with every step. Every size in the bin, every pair of them and every receiving bin is
looked at; the search ends with as few bins as the total allows or when no step is left. In the
second case the underfull bins and twice as many of the full ones, those of most pieces, are
packed anew in descending size (then four times as many, up to all); if that raises the squared
fill the search goes on from there.

What is in a shard's underfull bins, and in twice as many full ones of most pieces, is packed
once more with that of other shards, ``merge`` shards in one, and so on down to one shard, so
the shards' last bins do not add up.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each for
itself (their pieces have equal doc_id and piece); an empty table gives no rows; null ids are
kept; further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.text import chunks
from odonymy.llm.tokens import encoder
from odonymy.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Pieces of every document in token ids; nothing but their sizes and checksums goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in chunks(batches, limit=1 << 20):
            ids, bounds = encode(part.column("text").to_pylist())
            many = -(-np.diff(bounds) // length)
            row = np.repeat(np.arange(part.num_rows), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo = bounds[row] + piece * length
            hi = np.minimum(lo + length, bounds[row + 1])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(hi - lo), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of piece numbers: pieces as they come, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_rest: list[list[int]] = [[] for _ in range(room + 1)]
    open_rests = 0  # bit r: some bin has r left
    for i, s in enumerate(sizes):
        fits = open_rests >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_rest[r].pop()
            if not by_rest[r]:
                open_rests ^= 1 << r
            bins[b].append(i)
        else:
            r, b = room, len(bins)
            bins.append([i])
        by_rest[r - s].append(b)
        open_rests |= 1 << (r - s)
    return bins


class Search:
    """Local search over the underfull bins; see the module's text.

    Underfull bins are listed by the room they have left and by (size, room left) for each size they
    hold: a piece of size s can be exchanged for one of size t where s - t room or more is left.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.room, self.sizes, self.steps = room, sizes, 0
        self.rows: list[np.ndarray] | None = None  # of _rows, but for the bins in ``changed``
        self.changed: set[int] = set()
        self.held: list[dict[int, list[int]]] = []  # pieces of each bin by size
        for b in bins:
            own: dict[int, list[int]] = {}
            for i in b:
                own.setdefault(sizes[i], []).append(i)
            self.held.append(own)
        self.rest = [room - sum(sizes[i] for i in b) for b in bins]
        self.by_rest: list[dict[int, None]] = [{} for _ in range(room + 1)]
        self.open_rests = 0  # bit r: some listed bin has r left
        self.listed: dict[int, dict[int, None]] = {}  # bins by size * (room + 1) + rest
        self.here = np.zeros((room + 1) * (room + 1), bool)  # the same keys
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        r = self.rest[b]
        if not r or not self.held[b]:
            return
        self.by_rest[r][b] = None
        self.open_rests |= 1 << r
        for t in self.held[b]:
            key = t * (self.room + 1) + r
            at = self.listed.get(key)
            if at is None:
                self.listed[key] = {b: None}
                self.here[key] = True
            else:
                at[b] = None

    def _leave(self, b: int) -> None:
        r = self.rest[b]
        if b not in self.by_rest[r]:
            return
        del self.by_rest[r][b]
        if not self.by_rest[r]:
            self.open_rests ^= 1 << r
        for t in self.held[b]:
            key = t * (self.room + 1) + r
            at = self.listed[key]
            del at[b]
            if not at:
                del self.listed[key]
                self.here[key] = False

    def _take(self, b: int, size: int) -> int:
        own = self.held[b][size]
        i = own.pop()
        if not own:
            del self.held[b][size]
        self.rest[b] += size
        return i

    def _put(self, b: int, i: int) -> None:
        self.held[b].setdefault(self.sizes[i], []).append(i)
        self.rest[b] -= self.sizes[i]

    def _apply(self, a: int, gone: tuple[int, ...], b: int, *back: int) -> None:
        """Pieces of the sizes ``gone`` go from a to b, those of the sizes ``back`` return."""
        self._leave(b)
        out = [self._take(a, s) for s in gone]
        home = [self._take(b, s) for s in back]
        for i in out:
            self._put(b, i)
        for i in home:
            self._put(a, i)
        self._enter(b)
        self.changed |= {a, b}
        self.steps += 1

    def _move(self, a: int, s: int) -> bool:
        fits = self.open_rests >> s
        r = s + (fits & -fits).bit_length() - 1 if fits else self.room + 1
        if r <= self.rest[a]:  # the fullest bin with room; it is at least as full as a
            self._apply(a, (s,), next(iter(self.by_rest[r])))
            return True
        return False

    def _pairs(self, a: int) -> dict[int, tuple[int, ...]]:
        """Two sizes of a for each sum of two of its pieces; at most some 60 sizes fit a bin, so few."""
        sizes = sorted(self.held[a], reverse=True)
        out: dict[int, tuple[int, ...]] = {}
        for j, s in enumerate(sizes):
            for t in sizes[j if len(self.held[a][s]) > 1 else j + 1 :]:
                out.setdefault(s + t, (s, t))
        return out

    def _brim(self, a: int, choice: dict[int, tuple[int, ...]]) -> bool:
        """An exchange after which the receiver is full: size t there, s - t left."""
        wide = self.room + 1
        for s in sorted(choice, reverse=True):
            low = max(1, s - self.rest[a])
            # Keys of (t, s - t) for t from low to s - 1: they lie ``room`` apart.
            hit = self.here[low * wide + s - low : (s - 1) * wide + 2 : self.room]
            k = int(hit.argmax()) if len(hit) else 0
            if len(hit) and hit[k]:
                t = low + k
                self._apply(a, choice[s], next(iter(self.listed[t * wide + s - t])), t)
                return True
        return False

    def _rows(self, bins: Iterable[int]) -> list[np.ndarray]:
        """Of the underfull ones: rows (bin, size, 0, room left) and (bin, two sizes, room left)."""
        under = [b for b in bins if self.rest[b] and self.held[b]]
        one = [(b, t, 0, self.rest[b]) for b in under for t in self.held[b]]
        two = [(b, *pair, self.rest[b]) for b in under for pair in self._pairs(b).values()]
        return [np.array(x, np.int64).reshape(-1, 4) for x in (one, two)]

    def _others(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Those rows of all bins at least as full as a, a left out; rows of bins that have changed are made anew."""
        if self.rows is None or len(self.changed) > 100:
            self.rows, self.changed = self._rows(range(len(self.rest))), set()
        fresh = np.zeros(len(self.rest), bool)
        fresh[list(self.changed)] = True
        every = [np.concatenate([old[~fresh[old[:, 0]]], new]) for old, new in zip(self.rows, self._rows(self.changed), strict=True)]
        return tuple(x[(x[:, 3] <= self.rest[a]) & (x[:, 0] != a)] for x in every)

    def _any(self, a: int, choice: dict[int, tuple[int, ...]], rows: np.ndarray) -> bool:
        """Any other exchange for what one of the rows names: the one that fills the receiver most."""
        back = rows[:, 1] + rows[:, 2]
        most = back + rows[:, 3]
        edge = np.bincount(back + 1, minlength=2 * self.room + 3) - np.bincount(most + 1, minlength=2 * self.room + 3)
        able = np.cumsum(edge) > 0
        for s in sorted(choice, reverse=True):
            if able[s]:
                k = np.flatnonzero((back < s) & (s <= most))
                b, t, u, _ = rows[k[np.argmin(back[k])]].tolist()
                self._apply(a, choice[s], b, *((t, u) if u else (t,)))
                return True
        return False

    def _empty(self, a: int) -> None:
        """Takes out of bin a what can go."""
        self._leave(a)
        while self.held[a]:
            one = {s: (s,) for s in self.held[a]}
            if any(self._move(a, s) or self._brim(a, {s: (s,)}) for s in sorted(one, reverse=True)) or self._brim(a, self._pairs(a)):
                continue
            single, double = self._others(a)
            if not (self._any(a, one, single) or self._any(a, self._pairs(a), single) or self._any(a, one, double)):
                break
        self._enter(a)

    def run(self) -> int:
        """Searches until no step is left or there are as few bins as the total allows; returns the steps taken."""
        total = sum(self.room - r for r in self.rest)
        least, used = -(-total // self.room), sum(map(bool, self.held))
        before = -1
        while used > least and self.steps != before:
            before = self.steps
            for a in sorted((b for b, r in enumerate(self.rest) if 0 < r < self.room), key=lambda b: (-self.rest[b], b)):
                if 0 < self.rest[a] < self.room:
                    self._empty(a)
                    used -= not self.held[a]
                    if used <= least:
                        break
        return self.steps

    def bins(self) -> list[list[int]]:
        return [[i for own in b.values() for i in own] for b in self.held if b]


def improve(bins: list[list[int]], sizes: list[int], room: int) -> tuple[list[list[int]], int]:
    """(bins that are left after the local search, its steps); see the module's text."""
    steps, bins = 0, [b for b in bins if b]
    least = -(-sum(sizes) // room)
    while True:
        search = Search(bins, sizes, room)
        steps += search.run()
        bins = search.bins()
        if len(bins) <= least or (anew := _repacked(bins, sizes, room)) is None:
            return bins, steps
        bins = anew


def _by_fill(bins: list[list[int]], sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Numbers of the underfull bins, and of the full ones by descending number of pieces."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    full = sorted((k for k, f in enumerate(fill) if f == room), key=lambda k: (-len(bins[k]), k))
    return [k for k, f in enumerate(fill) if f < room], full


def _repacked(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]] | None:
    """The bins after a repacking that raises the squared fill; see the module's text."""
    under, full = _by_fill(bins, sizes, room)
    square = lambda b: sum(sizes[i] for i in b) ** 2
    many = 0
    while many < len(full):
        many = 4 * many or 2 * len(under)
        chosen = {*under, *full[:many]}
        pool = sorted((i for k in chosen for i in bins[k]), key=lambda i: (-sizes[i], i))
        anew = [[pool[j] for j in b] for b in best_fit([sizes[i] for i in pool], room)]
        if sum(map(square, anew)) > sum(square(bins[k]) for k in chosen):
            return [b for k, b in enumerate(bins) if k not in chosen] + anew
    return None


def pack(found: DataFrame, length: int = 2048, shard_tokens: int = 8_000_000, merge: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces (as from ``pieces``)."""
    found = materialize(found, "pieces")
    small = F.col("length") < length
    total, many = found.where(small).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, min(8, many // 2000), -(-total // shard_tokens))
    # Full pieces: numbers below zero, apart from all shards'.
    parts = [found.where(~small).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, turn = found.where(small), 0
    while True:
        # By place in the stored table, so that equal rows are dealt evenly as well.
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
        packed = dealt.groupBy("shard").applyInArrow(_packer(length, turn), PACKED + ", done boolean")
        if shards == 1:
            break
        packed = materialize(packed, "packed")
        parts.append(packed.where("done").drop("done"))
        left, turn, shards = packed.where("not done").select(found.columns), turn + 1, -(-shards // merge)
    parts.append(packed.drop("done"))
    return functools.reduce(DataFrame.union, parts)


def _packer(length: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    """Packs a shard; a row is ``done`` unless its bin is to be packed once more with those of other shards."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sizes = batch.column("length").to_pylist()
        shard = batch.column("shard")[0].as_py()
        seq, off, done = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool)
        bins = improve(best_fit(sizes, length), sizes, length)[0]
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = b, at
                at += sizes[i]
        under, full = _by_fill(bins, sizes, length)
        for b in under + full[: 2 * len(under)]:
            done[bins[b]] = False
        seq += (turn << 58) + (shard << 24)
        return batch.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).append_column("done", pa.array(done))

    return run
