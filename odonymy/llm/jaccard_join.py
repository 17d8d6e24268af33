"""Similarity join on word shingles by PartEnum signatures, and the classes it forms.

A document is the set of its distinct ``size``-word shingles (words are runs of bytes other
than white space, A-Z lower-cased; with fewer words the whole sequence is one shingle). Two
documents link if their Jaccard similarity is at least ``percent`` / 100.

Signatures (PartEnum). Sizes are cut into bands l..r with r <= l / similarity, so similar sets
lie in one band or in neighbours; a set signs for its own band and, if a larger partner can
lie there, for the next. In a band, linked sets differ in at most k shingles, k following from
r. The shingle domain is split into n parts by hash, and subsets of parts are enumerated:

* k = 0: the whole set.
* k <= 2: n = k + 3 parts; every subset of n - k parts is a signature. At least one subset
  avoids all differences.
* more, in two levels: g = floor(k / 2) + 1 + e groups of three parts; the subsets of two parts of
  each group are signatures. Of the 3 g at least A = 2 g - k (or 3 g - 2 k if k < g) hold no
  difference, as one difference in a group spoils two of its subsets and a second one the third.
  Every set drops its A - 1 weakest signatures (fewest shingles, ties by content): signatures
  without difference rank the same in both sets, so the strongest of them is dropped by neither.
  This keeps empty and nearly empty subsets from being signatures.

Sets with a signature in common gather around the least id that has it. Each gathering is
verified exactly: differences of each set from the shingles most of them have, counted against
each other, give every pair's symmetric difference; pairs already connected are skipped and
links between different classes go on. A gathering of more than ``cap`` shingles (a constant, so
memory does not grow with the input) is split into chunks, and each pair of chunks is a task of
its own; the list of such gatherings is broadcast only if the optimizer finds its table small. Links run through ``connected_components``.

Equal sets are collapsed beforehand and expand by membership only, never into pairs.

Defined cases: null, empty and wordless texts are empty sets, linked with nothing; repeated
rows and rows of one id are one vertex; null ids are ignored by the join and kept with a null
class; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.exchange import ABSENT, ENTRIES, block_of, entries, entry_table, look_up, replies, reply_keys
from odonymy.llm.frames import text_bytes
from odonymy.llm.text import U64, Hasher, chunks, mix, words_of
from odonymy.plans.graph import connected_components
from odonymy.session import discard, materialize, release

HASH = Hasher(41)
KEEP48 = U64(0xFFFFFFFFFFFF0000)
MEMBERS = "leader long, doc_id long, n int, shingles binary"
MEMBER_TYPES = pa.schema([("leader", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary())])


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; bounds of each text's)."""
    w = words_of(column, lower=True)
    h = HASH.ranges(w.data, w.starts, w.ends)
    count = np.diff(w.bounds)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = w.bounds[doc] + np.arange(bounds[-1]) - bounds[doc]
    length = np.minimum(count, size)[doc]
    out = np.zeros(len(at), U64)
    for k in np.unique(length).tolist():
        of = length == k
        out[of] = HASH.runs(h, k, at[of])
    for i in range(len(n)):
        out[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def set_digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in any order of its items."""
    sums = lambda x: np.concatenate([np.zeros(1, U64), np.cumsum(x)])
    a, b = sums(mix(h)), sums(mix(h ^ U64(0x5851F42D4C957F2D)))
    return tuple(mix(x[bounds[1:]] - x[bounds[:-1]] + np.diff(bounds).astype(U64)).view(np.int64) for x in (a, b))


class Bands:
    """Size bands for a similarity of percent / 100, with each band's number of differences."""

    def __init__(self, percent: int, largest: int):
        low, high = [1], []
        while True:
            high.append(low[-1] * 100 // percent)
            if high[-1] >= largest:
                break
            low.append(high[-1] + 1)
        # One band more: the largest set may sign for a next one.
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // percent)
        self.low, self.high = np.array(low), np.array(high)
        self.k = 2 * self.high * (100 - percent) // (100 + percent)
        self.percent = percent

    def signing(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their band) for the own band, then for the next one where a partner can lie there."""
        rows = np.flatnonzero(n > 0)
        own = np.searchsorted(self.low, n[rows], "right") - 1
        yield rows, own
        up = n[rows] * 100 // self.percent >= self.low[own + 1]
        yield rows[up], own[up] + 1


def signatures(h: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of every set's PartEnum signatures."""
    n = np.diff(bounds)
    bands = Bands(percent, int(n.max(initial=1)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    value = mix(h ^ U64(0xD1342543DE82EF95))
    low32, high32 = (value & U64(0xFFFFFFFF)).astype(np.float64), (value >> U64(32)).astype(np.float64)
    place = (h >> U64(32)).astype(np.int64)

    def parted(rows: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first part of each set, number and sum of the shingles in each part)."""
        first = np.concatenate([[0], np.cumsum(parts)])
        of = np.repeat(np.arange(len(rows)), n[rows])
        item = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(n[rows])[:-1]]), n[rows]) + np.arange(len(of))
        part = first[of] + place[item] % parts[of]
        total = np.bincount(part, low32[item], first[-1]).astype(U64) + (np.bincount(part, high32[item], first[-1]).astype(U64) << U64(32))
        return first, np.bincount(part, minlength=first[-1]), total

    def content(size: np.ndarray, total: np.ndarray) -> np.ndarray:
        return total + size.astype(U64) * U64(0x9E3779B97F4A7C15)

    for rows, band in bands.signing(n):
        k, salt = bands.k[band], mix((band.astype(U64) << U64(20)) + U64(7))
        large, few = np.flatnonzero(k > 2), np.flatnonzero(k <= 2)
        if len(large):
            groups = k[large] // 2 + 1 + -(-15 * k[large] // 100)
            first, size, total = parted(rows[large], 3 * groups)
            # Subsets of two parts, each at the place of the third one.
            size, total = ((x.reshape(-1, 3).sum(1, dtype=x.dtype)[:, None] - x.reshape(-1, 3)).ravel() for x in (size, total))
            owner = np.repeat(np.arange(len(large)), 3 * groups)
            index = np.arange(first[-1]) - first[owner]
            agree = np.where(k[large] < groups, 3 * groups - 2 * k[large], 2 * groups - k[large])
            order = np.lexsort((index, total, size, owner))
            strong = order[np.arange(len(order)) - first[owner[order]] >= agree[owner[order]] - 1]
            out.append((rows[large][owner[strong]], mix(content(size, total)[strong] + mix(salt[large][owner[strong]] + index[strong].astype(U64)))))
        if len(few):
            first, size, total = parted(rows[few], np.where(k[few] == 0, 1, k[few] + 3))
            value_of = content(size, total)
            for most in (0, 1, 2):
                sets = np.flatnonzero(k[few] == most)
                every = most + 3 if most else 1
                for number, chosen in enumerate(combinations(range(every), every - most)):
                    both = sum((value_of[first[sets] + p] for p in chosen), np.zeros(len(sets), U64))
                    out.append((rows[few][sets], mix(both + mix(salt[few][sets] + U64(1000 + number)))))
    text, sig = (np.concatenate([x[j] for x in out]) for j in (0, 1)) if out else (np.zeros(0, np.int64), np.zeros(0, U64))
    return text, sig & KEEP48


def links_within(sets: list[np.ndarray], ids: list[int], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' classes: every linked pair is connected by the links given.

    side: only pairs of different sides are looked at (pairs of chunks).
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    every, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    usual = count * 2 > m
    owner = np.repeat(np.arange(m), n)
    # Each set's difference from the usual shingles: others it has, usual ones it lacks.
    has = ~usual[index]
    lack_item, lack_owner = [], []
    base = np.flatnonzero(usual)
    have = np.split(index, np.cumsum(n)[:-1])
    for i in range(m):
        gone = np.setdiff1d(base, have[i], assume_unique=True)
        lack_item.append(gone)
        lack_owner.append(np.full(len(gone), i))
    item = np.concatenate([index[has], *lack_item])
    of = np.concatenate([owner[has], *lack_owner])
    diff = np.bincount(of, minlength=m)
    order = np.argsort(item, kind="stable")
    post = of[order]
    start = np.searchsorted(item[order], np.arange(len(every) + 1))
    mine = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[mine], np.arange(m + 1))
    label = np.arange(m)
    out = []
    where = np.array(side) if side else None
    for i in range(m):
        if (label == label[0]).all():
            break
        own = item[mine[cut[i] : cut[i + 1]]]
        lo, hi = start[own], start[own + 1]
        size = hi - lo
        flat = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        common = np.bincount(post[flat], minlength=m)
        apart = diff[i] + diff - 2 * common
        ok = (apart * (100 + percent) <= (n[i] + n) * (100 - percent)) & (label != label[i])
        if where is not None:
            ok &= where != where[i]
        for j in np.flatnonzero(ok).tolist():
            if label[j] != label[i]:
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


def similar(docs: DataFrame, size: int = 3, percent: int = 90, block_bytes: int = 3 << 20, cap: int = 100_000) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least id it reaches by links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = max(24, -(-text_bytes(docs) // block_bytes))
    buckets = max(24, blocks // 3)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            h, bounds = shingle_sets(part.column("text"), size)
            a, b = set_digests(h, bounds)
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "a", "b"])

    sizes = materialize(docs.mapInArrow(measure, "doc_id long, n_shingles long, a long, b long"), "set-sizes")
    least = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    least = materialize(least, "set-leads")  # read, not aggregated, beside the join: a hot set can then be split
    rows = docs.where("doc_id is not null").withColumn("block", block_of(blocks, "doc_id"))
    leads = least.select(block_of(blocks, "rep").alias("block"), F.col("rep").alias("doc_id"))

    def active(left: pa.Table, right: pa.Table) -> list[pa.RecordBatch]:
        """The texts that stand for their equals, in pieces of bounded size."""
        ids = pa.array(right.column("doc_id").drop_null().unique().to_pylist(), pa.int64())
        return list(chunks(left.filter(pa.compute.is_in(left.column("doc_id"), ids)).combine_chunks().to_batches()))

    def list_signatures(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for part in active(left, right) if left.num_rows and right.num_rows else []:
            h, bounds = shingle_sets(part.column("text"), size)
            text, sig = signatures(h, bounds, percent)
            found.append((sig, part.column("doc_id").to_numpy()[text]))
        if not found:
            return entry_table([])
        sig, owner = (np.concatenate([x[j] for x in found]) for j in (0, 1))
        return entry_table(list(entries(left.column("block")[0].as_py(), buckets, sig, np.zeros(len(sig), np.uint32), owner)))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        keys = reply_keys(right.select(["hi", "lo", "owner"]).to_pylist())
        for part in active(left, right) if left.num_rows and len(keys[0]) else []:
            h, bounds = shingle_sets(part.column("text"), size)
            text, sig = signatures(h, bounds, percent)
            leader = look_up(keys, sig, np.zeros(len(sig), np.uint32))
            ids = part.column("doc_id").to_numpy()
            got = leader != ABSENT
            pairs = np.unique(np.stack([text[got], leader[got]], 1), axis=0) if got.any() else np.zeros((0, 2), np.int64)
            for t, lead in pairs.tolist():
                s = h[bounds[t] : bounds[t + 1]]
                out.append({"leader": lead, "doc_id": int(ids[t]), "n": len(s), "shingles": s.tobytes()})
        return pa.Table.from_pylist(out, MEMBER_TYPES)

    listed = rows.groupBy("block").cogroup(leads.groupBy("block")).applyInArrow(list_signatures, ENTRIES)
    back = materialize(replies(listed), "signature-replies")
    release(docs.sparkSession)
    none = F.lit(None).cast("binary")
    right = leads.select("block", "doc_id", none.alias("hi"), none.alias("lo"), none.alias("owner")).union(back.select("block", F.lit(None).cast("long"), "hi", "lo", "owner"))
    members = materialize(rows.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(gather, MEMBERS), "gatherings")
    discard(back)
    release(docs.sparkSession)
    links = materialize(_links(members, percent, cap), "links")
    discard(members)
    release(docs.sparkSession)
    labels = connected_components(links)
    rep = sizes.join(least, ["a", "b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    return rep.join(labels, rep["rep"] == labels["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _links(members: DataFrame, percent: int, cap: int) -> DataFrame:
    # Read, not aggregated, beside the join, so its size is known when the join is planned.
    large = materialize(members.groupBy("leader").agg(F.sum("n").alias("t")).where(F.col("t") > cap).select("leader", F.ceil(F.col("t") / cap).cast("int").alias("k")), "large-gatherings", 8)
    dealt = members.join(large, "leader", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    # Chunk c meets every chunk: pairs (least, greatest).
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("leader", F.least("c", "o").cast("int").alias("x"), F.greatest("c", "o").cast("int").alias("y"), "c", "doc_id", "shingles")

    def verify(group: pa.Table) -> pa.Table:
        seen: dict[tuple[int, bytes], int] = {}
        for d, s, c in zip(group.column("doc_id").to_pylist(), group.column("shingles").to_pylist(), group.column("c").to_pylist(), strict=True):
            seen.setdefault((d, s), c)
        names = sorted(seen)
        two = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        found = links_within([np.frombuffer(s, U64) for _, s in names], [d for d, _ in names], percent, [seen[x] for x in names] if two else None) if len(names) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("leader", "x", "y").applyInArrow(verify, "a long, b long").where("a <> b")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose id is the least of their class, with their own columns (one row for an id and text; null ids all stay)."""
    classes = similar(docs, size, percent).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    # Rows as one column, so that none of theirs stands beside ours.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    # Only rows of ids that occur more than once are grouped by text; all other rows are as they were.
    again = materialize(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids", 8)
    left = rows.join(classes, "id", "left_anti")
    if not again.isEmpty():
        copies = left.join(again, "id", "left_semi").dropDuplicates(["id", "a", "b"])
        left = left.join(again, "id", "left_anti").unionByName(copies)
    return left.select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return found.select("doc_id", "n_shingles", "component_id")
