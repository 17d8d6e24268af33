"""Benchmark decontamination: a prefix-filtered containment join.

Every benchmark item gives windows of ``size`` consecutive words (an item with fewer words,
but not none, is one window). A window is contained where a document has its words in a row.

Method. A window is a set of shingles of ``shingle`` words (of all its words if it has fewer).
Shingles are ordered by rarity: their number of occurrences over all documents, ties by hash. For
containment of a whole window the necessary prefix is its one rarest shingle, so only that one
is looked up among the document's shingles. A hit at position p with the shingle at
offset o of the window gives the one place p - o where the window can start (positional
bound); the place must lie in the document with its full length (length bound). What is left
is verified first by hash, then word by word on the bytes.

The benchmark side is sent to the executors in blocks of at most ``block_windows`` windows
(about 100 bytes each; a long item's windows are spread over blocks), so what is broadcast has a
fixed size. With more than one block each one is a pass over the documents; its hits go to the
shared folder before the next block is read, and are merged per row (by id, nulls alike, and a
hash of the text, so rows of one id do not share hits).

Defined cases: null or wordless texts and items have no words and no windows; a repeated
item_id unites its texts' windows; null ids are kept as null document ids and ignored as
item ids; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.text import NONWORD, Hasher, chunks, words_of
from odonymy.session import materialize

HASH = Hasher(81)
SCHEMA = "doc_id long, sha string, n_words long, hit_spans array<struct<start:long,end:long>>, item_ids array<string>"
COLUMNS = ["doc_id", "n_words", "hit_spans", "item_ids"]


class Keys:
    """Sorted hashes with a bit table in front that rules out most others."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.shift = np.uint64(64 - max(20, min(26, int(16 * len(self.sorted)).bit_length())))
        self.filt = np.zeros(1 << int(64 - self.shift), bool)
        self.filt[(self.sorted >> self.shift).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of hashes that are there, and their places in ``sorted``."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filt[(h >> self.shift).astype(np.int64)])
        k = np.searchsorted(self.sorted, h[at])
        k[k == len(self.sorted)] = 0
        ok = self.sorted[k] == h[at]
        return at[ok], k[ok]


def item_windows(ident: object, text: str, size: int) -> Iterator[tuple[tuple[bytes, ...], str, dict[bytes, int]]]:
    """Each window of an item with the item's id as text and the hashes of its words."""
    w = words_of(pa.array([text]), lower=True, gap=NONWORD)
    raw, name = w.data.tobytes(), str(ident)
    words = [raw[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
    hashes = HASH.ranges(w.data, w.starts, w.ends).tolist()
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[i : i + size]), name, dict(zip(words[i : i + size], hashes[i : i + size], strict=True))


def window_blocks(items: Iterator[tuple[object, str]], size: int, most: int) -> Iterator[tuple[dict[tuple[bytes, ...], set], dict[bytes, int]]]:
    """The benchmark's windows with the ids they stand for, and a hash of each word, ``most`` windows at a time; one block at least."""
    block: dict[tuple[bytes, ...], set] = defaultdict(set)
    known: dict[bytes, int] = {}
    full = False
    for ident, text in items:
        for window, name, hashes in item_windows(ident, text, size):
            if len(block) >= most and window not in block:
                yield block, known
                block, known, full = defaultdict(set), {}, True
            block[window].add(name)
            known |= hashes
    if block or not full:
        yield block, known


class Shingled:
    """The shingles of a benchmark block's windows, by number of words (fewer than ``shingle`` in short windows only)."""

    def __init__(self, windows: dict[tuple[bytes, ...], set], known: dict[bytes, int], shingle: int):
        self.windows = [(w, sorted(ids)) for w, ids in sorted(windows.items())]
        self.size = np.array([len(w) for w, _ in self.windows], np.int64)
        first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        words = np.array([known[x] for w, _ in self.windows for x in w], np.uint64)
        of = np.repeat(np.arange(len(self.size)), self.size)
        offset = np.arange(len(words)) - first[of]
        #: Of each number of words: hash, window and offset of every shingle.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.key = np.zeros(len(self.size), np.uint64)
        for n in np.unique(self.size).tolist():
            self.key[self.size == n] = HASH.runs(words, n, first[:-1][self.size == n])
        wide = np.minimum(self.size, shingle)
        for k in np.unique(wide).tolist():
            at = np.flatnonzero((wide[of] == k) & (offset + k <= self.size[of]))
            self.shingles[k] = HASH.runs(words, k, at), of[at], offset[at]


def shingle_counts(docs: DataFrame, block: Shingled, text_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(hashes ascending, occurrences over all documents) of the block's shingles, by number of words: what orders them by rarity."""
    keys = {k: Keys(h) for k, (h, _, _) in block.shingles.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: np.zeros(len(x.sorted), np.int64) for k, x in keys.items()}
        for part in chunks(batches):
            w = words_of(part.column("text"), lower=True, gap=NONWORD)
            h = HASH.ranges(w.data, w.starts, w.ends)
            for k, x in keys.items():
                n[k] += np.bincount(x.places(HASH.runs(h, k, w.windows(k)))[1], minlength=len(x.sorted))
        for k, x in keys.items():
            got = np.flatnonzero(n[k])
            yield pa.record_batch({"w": np.full(len(got), k, np.int32), "k": x.sorted[got].view(np.int64), "n": n[k][got]})

    out = {k: (x.sorted, np.zeros(len(x.sorted), np.int64)) for k, x in keys.items()}
    if out:
        # At most as many rows as a block has shingles.
        for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "w int, k long, n long").groupBy("w", "k").agg(F.sum("n").alias("n")).collect():
            hashes, n = out[r.w]
            n[np.searchsorted(hashes, np.uint64(r.k % (1 << 64)))] = r.n
    return out


class Matcher:
    """Finds the windows of one benchmark block in batches of documents."""

    def __init__(self, block: Shingled, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.windows, self.size, self.key = block.windows, block.size, block.key
        #: By number of words: the prefixes, where each one's windows begin, and the windows with the prefix's offset.
        self.prefixes: dict[int, tuple[Keys, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (h, of, offset) in block.shingles.items():
            hashes, n = counts[k]
            order = np.lexsort((offset, h, n[np.searchsorted(hashes, h)], of))
            rarest = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
            rarest = rarest[np.argsort(h[rarest], kind="stable")]
            keys = Keys(h[rarest])
            self.prefixes[k] = keys, np.searchsorted(h[rarest], keys.sorted), of[rarest], offset[rarest]

    def _candidates(self, w, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word at which a prefix stands, word at which its window would start, window)."""
        for k, (keys, first, which, offset) in self.prefixes.items():
            at = w.windows(k)
            place, key = keys.places(HASH.runs(h, k, at))
            many = np.append(first, len(which))[key + 1] - first[key]
            flat = np.arange(many.sum()) + np.repeat(first[key] - np.cumsum(many) + many, many)
            yield np.repeat(at[place], many), np.repeat(at[place], many) - offset[flat], which[flat]

    def __call__(self, w) -> list[tuple[int, int, int, int]]:
        """(document, first word, end word, window) of each verified occurrence; words count from the batch's first."""
        if not len(self.size) or not len(w.starts):
            return []
        h = HASH.ranges(w.data, w.starts, w.ends)
        pos, start, which = (np.concatenate(x) for x in zip(*self._candidates(w, h), strict=True))
        doc = np.searchsorted(w.bounds, pos, "right") - 1
        ok = (start >= w.bounds[doc]) & (start + self.size[which] <= w.bounds[doc + 1])
        start, which, doc = start[ok], which[ok], doc[ok]
        out, raw = [], None
        for n in np.unique(self.size[which]):
            of = np.flatnonzero(self.size[which] == n)
            for j in of[HASH.runs(h, int(n), start[of]) == self.key[which[of]]].tolist():
                raw = raw or w.data.tobytes()
                s = int(start[j])
                if all(raw[w.starts[s + i] : w.ends[s + i]] == x for i, x in enumerate(self.windows[which[j]][0])):
                    out.append((int(doc[j]), s, s + int(n), int(which[j])))
        return out


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _one_block(docs: DataFrame, find: Matcher) -> DataFrame:
    typ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = words_of(part.column("text"), lower=True, gap=NONWORD)
            spans, ids = defaultdict(list), defaultdict(set)
            for d, s, e, i in find(w):
                spans[d].append((s - int(w.bounds[d]), e - int(w.bounds[d])))
                ids[d].update(find.windows[i][1])
            n = part.num_rows
            yield pa.record_batch([part.column("doc_id"), part.column("sha"), pa.array(np.diff(w.bounds)), pa.array([_merge(spans[i]) if i in spans else [] for i in range(n)], typ), pa.array([sorted(ids[i]) if i in ids else [] for i in range(n)], pa.list_(pa.string()))], ["doc_id", "sha", "n_words", "hit_spans", "item_ids"])

    return docs.mapInArrow(run, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 200_000, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, n_words, hit_spans (word ranges inside windows, merged), item_ids (sorted as strings)."""
    first, later = _passes(docs, benchmark, size, id_col, text_col, item_col, item_text_col, block_windows, shingle)
    if not later:
        return first.select(*COLUMNS)
    # Only rows with hits were written. Exact copies of a row have the same hits: one of them is enough.
    hits = functools.reduce(DataFrame.union, later).distinct()
    merged = hits.groupBy("doc_id", "sha").agg(F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"))
    fold = F.aggregate("s", F.expr("cast(array() as array<struct<start:long,end:long>>)"), lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.element_at(a, -1)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    empty = F.expr("cast(array() as array<string>)")
    rows, merged = first.select("doc_id", "sha", "n_words"), merged.select(F.col("doc_id").alias("hit_id"), F.col("sha").alias("hit_sha"), fold.alias("hit_spans"), "i")
    rows = rows.join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sha") == F.col("hit_sha")), "left")
    return rows.select("doc_id", "n_words", F.coalesce("hit_spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("hit_spans"), F.coalesce("i", empty).alias("item_ids"))


def _passes(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 200_000, shingle: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """(all rows with a hash of their text and their hits by the last block; with more than one block, each block's rows with hits)."""
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    blocks = window_blocks(((r.i, r.t) for r in items.toLocalIterator()), size, block_windows)
    written: list[DataFrame] = []
    block, after = next(blocks), next(blocks, None)
    while True:
        shingled = Shingled(*block, shingle)
        found = _one_block(docs, Matcher(shingled, shingle_counts(docs, shingled, "text")))
        if after is not None or written:
            written.append(materialize(found.where("size(item_ids) > 0").select("doc_id", "sha", "hit_spans", "item_ids"), "benchmark-hits"))
        if after is None:
            return found, written
        block, after = after, next(blocks, None)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op8."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def sha_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = 200_000) -> DataFrame:
    """Documents without any benchmark window, with their own columns."""
    first, later = _passes(docs, benchmark, size, block_windows=block_windows)
    hits = functools.reduce(DataFrame.union, later) if later else first.where("size(item_ids) > 0")
    bad = hits.select(F.col("doc_id").alias("hit_id"), F.col("sha").alias("hit_sha")).distinct()
    # By id (null too) and text: rows without an id go as well, other texts of the same id stay.
    same = docs["doc_id"].cast("long").eqNullSafe(bad["hit_id"]) & (F.sha2(docs["text"].cast("binary"), 256) == bad["hit_sha"])
    return docs.join(bad, same, "left_anti")
