"""Exact substring deduplication by level-wise doubling.

A window is ``length`` consecutive words of one document; it repeats if other documents have
it too. Levels are lengths, each about twice the one before: ``length`` halved (rounded up) down
to ``SHORTEST`` words or more, so 7, 13 for 13 words and 7, 13, 25, 50 for 50. Windows are looked
at on one level only if they repeat on the level before, so the work shrinks with every level,
until no candidates survive or the length is reached.

* Levels below the length: of the windows of that level inside each window of the length only
  the one with the least hash is listed (equal windows choose the same one), with 48 bits of its
  hash. Where it has no second owner the window cannot repeat and is given up.
* The length's own level lists the windows left, under 96-bit names. It decides.

Texts are read by the first two steps only; the hashes of all later levels are kept for the
windows that survive the first.

Sharing is found by ``exchange``: blocks of documents list distinct keys, buckets reply. Exact
copies of a text take no part: only the least id of each text does; the others lose every
word that any window covers, as the same windows start in the least one.

Words are runs of bytes other than white space (20, 09-0D hex), compared as they are. Removed
are the words covered by windows whose words also start in a document with a smaller id,
judged on the input as it is. Texts are told apart by 128 bits of hash.

Defined cases: null texts have no words, nothing removed and an empty rest; texts shorter than
a window keep all words; null ids are kept, take no part and lose nothing; repeated rows (equal
id and text) fare alike and do not remove each other, nor do different texts under one id, each
of which is a document of its own; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress as pick

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.llm.exchange import ABSENT, ENTRIES, block_of, entries, entry_table, look_up, replies, reply_keys
from odonymy.llm.frames import text_bytes
from odonymy.llm.text import SPACE, U64, Hasher, Words, chunks, planes, split, unplanes, utf8
from odonymy.session import discard, materialize, release

FIRST, SECOND = Hasher(11), Hasher(12)
KEEP48 = U64(0xFFFFFFFFFFFF0000)
#: Words of the shortest level, unless the length itself is shorter.
SHORTEST = 6
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: A document (done if it has kept_sha256) or, without an id, the block's surviving windows as packed arrays.
STATE = "block int, place int, doc_id long, a long, b long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>, docs binary, places binary, pos binary, hi binary, lo binary, under array<binary>"
STATE_TYPES = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", SPANS), *((c, pa.binary()) for c in ("docs", "places", "pos", "hi", "lo")), ("under", pa.list_(pa.binary()))])
RESULT = ["doc_id", "a", "b", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"]


def level_lengths(length: int) -> list[int]:
    """Lengths of the levels, ascending; the last is ``length``."""
    out = [length]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of n consecutive values from each place (fewer at the end), by doubling."""
    out, done = h.copy(), 1
    while done < n:
        step = min(done, n - done)
        np.minimum(out[:-step], out[step:].copy(), out=out[:-step])
        done += step
    return out


def _chosen(words: np.ndarray, at: np.ndarray, length: int, part: int) -> np.ndarray:
    """For each window start in ``at``: the least hash of the ``part`` words inside the window."""
    if not len(at):
        return np.zeros(0, U64)
    # Hashes at all places, junk beyond a text's end: a window never looks there.
    h = FIRST.runs(words, part, np.arange(len(words) - part + 1)) & KEEP48
    return _least(h, length - part + 1)[at]


def _words(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
    data, off = utf8(table.column("text"))
    w = split(data, off, SPACE)
    return w, FIRST.ranges(w.data, w.starts, w.ends), table.column("doc_id").to_numpy()


def _parts(table: pa.Table) -> list[pa.Table]:
    """A block in pieces of bounded text."""
    return [pa.Table.from_batches([b]) for b in chunks(table.combine_chunks().to_batches())]


def _final(row: dict, text: str | None, gone: np.ndarray | None, keep_text: bool) -> dict:
    """A document that is done: what is left of it, and the word ranges that are not."""
    words = (text or "").encode().split()
    spans: list[dict] = []
    if gone is not None and gone.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
        words = list(pick(words, (~gone).tolist()))
    rest = b" ".join(words)
    kept = rest.decode() if spans and keep_text else None
    return row | {"n_removed": sum(s["end"] - s["start"] for s in spans), "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept_text": kept, "removed": spans}


def _key() -> tuple[Column, ...]:
    """doc_id and 128 bits of the text's hash (a, b); null texts have those of the empty text and count as it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_key(), F.col("text").cast("string").alias("text"))


def _results(docs: DataFrame, length: int, keep_text: bool, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(a row of RESULT for each distinct id and text, repeated (doc_id, a, b) or None), of ``_keyed`` rows with an id."""
    blocks = max(24, -(-text_bytes(docs) // block_bytes))
    buckets = max(24, blocks // 3)
    levels = level_lengths(length)
    # Stored tables have a file for every so many blocks: each file costs a task and, on some file systems, processes.
    few = max(8, blocks // 8)
    pairs = materialize(docs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("rows")), "dedup-texts", few)
    leads = pairs.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    again = materialize(pairs.where("rows > 1").select("doc_id", "a", "b"), "dedup-repeated", few)
    if again.isEmpty():
        again, rows = None, docs
    else:
        # Of equal rows one is worked on; the others are read off its result.
        same = docs.join(again, ["doc_id", "a", "b"], "left_semi").dropDuplicates(["doc_id", "a", "b"])
        rows = docs.join(again, ["doc_id", "a", "b"], "left_anti").unionByName(same)
    rows = rows.withColumn("block", block_of(blocks, "doc_id", "a", "b"))
    leads = leads.select(block_of(blocks, "doc_id", "a", "b").alias("block"), "doc_id", "a", "b")

    def active(table: pa.Table, lead: pa.Table) -> np.ndarray:
        """Rows that take part: those of the least id of each text."""
        names = lambda t: zip(*(t.column(c).to_pylist() for c in ("doc_id", "a", "b")), strict=True)
        take = set(names(lead))
        return np.fromiter((n in take for n in names(table)), bool, table.num_rows)

    def list_first(left: pa.Table, right: pa.Table) -> pa.Table:
        """Keys of the first level."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            for part in _parts(left.filter(pa.array(active(left, right)))):
                w, words, ids = _words(part)
                at = w.windows(length)
                key = _chosen(words, at, length, levels[0]) if len(levels) > 1 else FIRST.runs(words, length, at) & KEEP48
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (np.diff(at) != 1)
                found.append((key[new], ids[np.searchsorted(w.bounds, at[new], "right") - 1]))
        if not found:
            return entry_table([])
        key, owner = (np.concatenate([x[j] for x in found]) for j in (0, 1))
        return entry_table(list(entries(left.column("block")[0].as_py(), buckets, key, np.zeros(len(key), np.uint32), owner)))

    def survivors(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents without a surviving window are done; the others' windows get names and the keys of the levels to come."""
        if not left.num_rows:
            return pa.Table.from_pylist([], STATE_TYPES)
        block = left.column("block")[0].as_py()
        is_lead = pa.compute.is_null(right.column("hi"))
        ok = active(left, right.filter(is_lead))
        keys = reply_keys(right.filter(pa.compute.invert(is_lead)).select(["hi", "lo", "owner"]).to_pylist())
        out: list[dict] = []
        state: list[tuple] = []
        done = 0
        for part in _parts(left):
            w, words, ids = _words(part)
            at = w.windows(length)
            doc = np.searchsorted(w.bounds, at, "right") - 1
            key = _chosen(words, at, length, levels[0]) if len(levels) > 1 else FIRST.runs(words, length, at) & KEEP48
            cand = np.flatnonzero(ok[done + doc])
            cand = cand[look_up(keys, key[cand], np.zeros(len(cand), np.uint32)) != ABSENT]
            under = [_chosen(words, at, length, n)[cand] for n in levels[1:-1]]
            at, doc = at[cand], doc[cand]
            hi = FIRST.runs(words, length, at)
            lo = (SECOND.runs(SECOND.ranges(w.data, w.starts, w.ends), length, at) >> U64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
            has = np.zeros(part.num_rows, bool)
            has[doc] = True
            total = np.diff(w.bounds).tolist()
            for i, (text, a, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "a", "b")), strict=True)):
                row = {"place": done + i, "doc_id": int(ids[i]), "a": a, "b": b, "n_words": total[i]}
                # A copy of a text whose least id is elsewhere is covered by windows from end to end.
                copy = not ok[done + i] and total[i] >= length
                out.append(row | {"kept_text": text} if has[i] else _final(row, text, np.ones(total[i], bool) if copy else None, keep_text))
            state.append((ids[doc], (done + doc).astype(np.int32), (at - w.bounds[doc]).astype(np.int32), hi, lo, *under))
            done += part.num_rows
        packed = [planes(np.concatenate([s[j] for s in state])) for j in range(len(state[0]))]
        if packed[0]:
            out.append(dict(zip(("docs", "places", "pos", "hi", "lo"), packed, strict=False)) | {"under": packed[5:]})
        return pa.Table.from_pylist([r | {"block": block} for r in out], STATE_TYPES)

    none = F.lit(None)
    first = materialize(replies(rows.groupBy("block").cogroup(leads.groupBy("block")).applyInArrow(list_first, ENTRIES)), "dedup-replies")
    release(docs.sparkSession)
    right = leads.select("*", *(none.cast("binary").alias(c) for c in ("hi", "lo", "owner"))).union(first.select("block", *(none.cast("long") for _ in range(3)), "hi", "lo", "owner"))
    state = materialize(rows.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(survivors, STATE), "dedup-windows")
    discard(first)
    discard(pairs)
    release(docs.sparkSession)
    done, level = state.where("kept_sha256 is not null"), state.where("kept_sha256 is null")
    for turn in range(1, len(levels) - 1):
        # A block's windows are one row, documents without a decision some more.
        level = materialize(_level(level, turn, levels, buckets, keep_text), "dedup-level", few)
        done, level = done.union(level.where("kept_sha256 is not null")), level.where("kept_sha256 is null")
        if level.isEmpty():
            return done.select(*RESULT), again
    done = done.union(_level(level, len(levels) - 1, levels, buckets, keep_text))
    return done.select(*RESULT), again


#: Places and positions fit 32 bits, as a text has fewer than 2**31 bytes.
ARRAYS = (("docs", np.int64), ("places", np.int32), ("pos", np.int32), ("hi", U64), ("lo", np.uint32))


def _level(level: DataFrame, turn: int, levels: list[int], buckets: int, keep_text: bool) -> DataFrame:
    """One level after the first: which windows still repeat; the last one decides what is removed."""
    length, last = levels[-1], turn == len(levels) - 1

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        if last:
            return unplanes(row["hi"], U64), unplanes(row["lo"], np.uint32)
        key = unplanes(row["under"][turn - 1], U64)
        return key, np.zeros(len(key), np.uint32)

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # a block's windows are one row
                yield from entry_table(list(entries(row["block"], buckets, *keys_of(row), unplanes(row["docs"], np.int64)))).to_batches()

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        own = next((r for r in rows if r["docs"]), None)
        if not rows or own is None:
            return pa.Table.from_pylist([], STATE_TYPES)
        owner = look_up(reply_keys(right.select(["hi", "lo", "owner"]).to_pylist()), *keys_of(own))
        docs, places, pos, hi, lo = (unplanes(own[c], t) for c, t in ARRAYS)
        stay = (owner < docs) & (owner != ABSENT) if last else owner != ABSENT
        order = np.flatnonzero(stay)
        order = order[np.argsort(places[order], kind="stable")]
        names = [r["place"] for r in rows if r["doc_id"] is not None]
        first, end = (dict(zip(names, np.searchsorted(places[order], names, side).tolist(), strict=True)) for side in ("left", "right"))
        out = []
        for r in rows:
            if r["doc_id"] is None:
                continue
            mine = order[first[r["place"]] : end[r["place"]]]
            if len(mine) and not last:
                out.append(r)
                continue
            edge = np.zeros(r["n_words"] + 1, np.int64)
            np.add.at(edge, pos[mine], 1)
            np.add.at(edge, pos[mine] + length, -1)
            out.append(_final({c: r[c] for c in ("place", "doc_id", "a", "b", "n_words")}, r["kept_text"], np.cumsum(edge[:-1]) > 0, keep_text))
        if len(order) and not last:
            packed = {c: planes(x[order]) for (c, _), x in zip(ARRAYS, (docs, places, pos, hi, lo), strict=True)}
            out.append(packed | {"under": [planes(unplanes(u, U64)[order]) for u in own["under"]]})
        return pa.Table.from_pylist([r | {"block": own["block"]} for r in out], STATE_TYPES)

    back = replies(level.where("docs is not null").mapInArrow(list_keys, ENTRIES))
    return level.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(settle, STATE)


def find(docs: DataFrame, length: int = 13, keep_text: bool = False, block_bytes: int = 3 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text (if asked for and words were taken out; else the text is as it was) and removed, the word ranges taken out."""
    docs = _keyed(docs)
    rows = docs.where("doc_id is not null")
    out, again = _results(rows, length, keep_text, block_bytes)
    if again is not None:  # every row of a repeated id and text has that one's result
        # The key columns of ``rows`` are aliased: a column and its copy never stand on both sides under one name.
        key = rows.select(F.col("doc_id").alias("i"), F.col("a").alias("x"), F.col("b").alias("y"))
        out = key.join(out, (F.col("i") == F.col("doc_id")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).select(*RESULT)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lost = docs.where("doc_id is null").select("doc_id", F.size(words).cast("long"), F.lit(0).cast("long"), F.sha2(F.concat_ws(" ", words).cast("binary"), 256), F.lit(None).cast("string"), F.expr("cast(array() as array<struct<start:long,end:long>>)"))
    return out.drop("a", "b").union(lost)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """The documents with repeated words taken out of their texts; documents with nothing left go.

    Documents that lose nothing keep their texts unchanged; n_chars follows the text.
    """
    found, _ = _results(_keyed(docs).where("doc_id is not null"), length, True, 3 << 20)
    lost = found.where("n_removed > 0").select(F.struct("doc_id", "a", "b", "kept_text").alias("lost"))
    rows = docs.select(F.struct("*").alias("row"), F.struct(*_key()).alias("key"))  # no column of docs stands beside ours
    same = (F.col("key.doc_id") == F.col("lost.doc_id")) & (F.col("key.a") == F.col("lost.a")) & (F.col("key.b") == F.col("lost.b"))
    out = rows.join(lost, same, "left").where("lost is null or lost.kept_text <> ''")
    new = {"text": F.col("lost.kept_text"), "n_chars": F.length("lost.kept_text")}
    old = lambda c: F.col("row").getField(c)
    types = dict(docs.dtypes)
    return out.select(*((F.when(F.col("lost").isNotNull(), new[c].cast(types[c])).otherwise(old(c)) if c in new else old(c)).alias(c) for c in docs.columns))
