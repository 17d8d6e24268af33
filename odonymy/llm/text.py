"""Word and hash arrays over whole Arrow batches of text, without a Python loop per word.

All functions work on UTF-8 bytes. A batch's texts lie end to end in one byte array;
words never cross a text's end. Nulls count as empty texts. Hashes are polynomials modulo
2**64 over random per-byte values, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is worked on alone, whole.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside [0-9A-Za-z] and below 0x80, plus capitals (texts are lower-cased first).
NONWORD = np.ones(256, bool)
NONWORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, but one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finisher on uint64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


#: Multipliers for bytes and for words, one table of powers each in a process.
BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


class Hasher:
    """Hashes of byte ranges and of runs of words; the random values of a seed give independent functions."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed).integers(0, 1 << 64, 256, U64)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = BYTE_POWERS.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def runs(self, words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        """Hash of the n words from each position in ``at``."""
        up, down = WORD_POWERS.upto(len(words) + 1)
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:-1], out=total[1:])
        return mix((total[at + n] - total[at]) * down[at] + U64(n))


@dataclass
class Words:
    """Words of a batch of texts. bounds[i]:bounds[i+1] are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, n: int) -> np.ndarray:
        """Positions at which n words of one text begin."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)


def split(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> Words:
    """Maximal runs of bytes that are not in ``gap``, within each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64))
    inside = ~gap[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    stop[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False, gap: np.ndarray = SPACE) -> Words:
    data, off = utf8(column)
    return split(LOWER[data] if lower else data, off, gap)


def planes(a: np.ndarray) -> bytes:
    """Little-endian bytes with the first bytes of all items first: compresses well if items are alike."""
    a = np.ascontiguousarray(a).ravel()
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
