"""Finding keys that several owners share, over blocks of documents.

Documents are dealt into blocks by a hash. A block lists its distinct keys, each
once, with the least owner in the block and whether the block has more than one owner of it.
The lists go to buckets by key; a bucket sees at most one entry of a key for each block, so a
key that a third of all documents hold is a list of blocks there, no list of documents. It
replies to every block with the keys that have two owners or more, and their least owner. What
the block does with a reply - which documents, which positions - it works out itself.

Lists and replies are packed arrays, a row for each (block, bucket) that has keys, so there are
never more rows than keys. Blocks and buckets grow in number with the input, not in size. How
documents are dealt to blocks is free: an owner may occur in several blocks (its keys then count
as shared, with itself as the least owner if no smaller one has them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.llm.text import U64, planes, unplanes

ENTRIES = "bucket int, block int, hi binary, lo binary, owner binary, many binary"
REPLIES = "block int, hi binary, lo binary, owner binary"
ENTRY_TYPES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()), ("owner", pa.binary()), ("many", pa.binary())])


def block_of(blocks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def distinct_keys(hi: np.ndarray, lo: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key (hi, lo) once, ascending: hi, lo, least owner, whether it has several owners."""
    order = np.lexsort((owner, lo, hi)) if lo.any() else np.lexsort((owner, hi))
    hi, lo, owner = hi[order], lo[order], owner[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hi)) - 1
    if not len(first):
        return hi, lo, owner, np.zeros(0, bool)
    return hi[first], lo[first], owner[first], owner[first] != owner[last]


def entries(block: int, buckets: int, hi: np.ndarray, lo: np.ndarray, owner: np.ndarray) -> Iterator[dict]:
    """Rows of ENTRIES for a block's keys; hi decides the bucket, as hashes are ascending."""
    hi, lo, owner, many = distinct_keys(hi, lo, owner)
    bucket = hi // U64((1 << 64) // buckets + 1)
    cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(hi)]]).tolist() if len(hi) else []
    for lo_, hi_ in zip(cut[:-1], cut[1:], strict=True):
        s = slice(lo_, hi_)
        yield {"bucket": int(bucket[lo_]), "block": block, "hi": planes(hi[s]), "lo": planes(lo[s]), "owner": planes(owner[s]), "many": np.packbits(many[s]).tobytes()}


def entry_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, ENTRY_TYPES)


def _reply(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    hi = [unplanes(r["hi"], U64) for r in rows]
    size = [len(h) for h in hi]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n) for r, n in zip(rows, size, strict=True)]).astype(bool)
    lo = np.concatenate([unplanes(r["lo"], np.uint32) for r in rows])
    owner = np.concatenate([unplanes(r["owner"], np.int64) for r in rows])
    of, hi = np.repeat(np.arange(len(rows)), size), np.concatenate(hi)
    order = np.lexsort((owner, lo, hi)) if lo.any() else np.lexsort((owner, hi))
    h, l, o = hi[order], lo[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    shared = (np.diff(np.append(first, len(h))) > 1) | np.maximum.reduceat(many[order], first)
    at = np.flatnonzero(shared[run])
    h, l, o, b = h[at], l[at], o[first][run[at]], of[order][at]
    by_row = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[by_row], np.arange(len(rows) + 1))
    out = []
    for i, r in enumerate(rows):
        s = by_row[cut[i] : cut[i + 1]]
        if len(s):
            out.append({"block": r["block"], "hi": planes(h[s]), "lo": planes(l[s]), "owner": planes(o[s])})
    return pa.Table.from_pylist(out, pa.schema([(f.name, f.type) for f in ENTRY_TYPES if f.name in ("block", "hi", "lo", "owner")]))


def replies(listed: DataFrame) -> DataFrame:
    """REPLIES to rows of ENTRIES."""
    return listed.groupBy("bucket").applyInArrow(_reply, REPLIES)


def reply_keys(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all replies to a block, ascending by (hi, lo), with their least owners."""
    rows = [r for r in rows if r.get("hi")]
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hi, lo, owner = (np.concatenate([unplanes(r[c], t) for r in rows]) for c, t in (("hi", U64), ("lo", np.uint32), ("owner", np.int64)))
    order = np.lexsort((lo, hi))
    return hi[order], lo[order], owner[order]


def look_up(keys: tuple[np.ndarray, np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Least owner of each (hi, lo) that was replied, ABSENT for the others."""
    khi, klo, kowner = keys
    out = np.full(len(hi), np.iinfo(np.int64).min)
    if not len(khi) or not len(hi):
        return out
    at = np.searchsorted(khi, hi)
    left = np.arange(len(hi))
    while len(left):  # keys with the same hi stand in a row, nearly always one
        i = at[left]
        ok = (i < len(khi)) & (khi[np.minimum(i, len(khi) - 1)] == hi[left])
        left, i = left[ok], i[ok]
        hit = klo[i] == lo[left]
        out[left[hit]] = kowner[i[hit]]
        left = left[~hit]
        at[left] += 1
    return out


#: What look_up gives for a key that was not replied.
ABSENT = np.iinfo(np.int64).min
