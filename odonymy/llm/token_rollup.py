"""Delta-maintained rollups of token counts by source, language and tokenizer version.

State is a folder of signed deltas and of one snapshot. A batch of changes - inserts, deletes
and revised counts - becomes additive deltas: an insert adds, a delete takes away, a revision
takes the old count away and adds the new one. Deltas are summed within the batch before they
are written, so a hot source is a few rows.

Commits are idempotent: an attempt at a batch is a folder of its own under the batch's id and counts
only if Spark's own success mark is there. A batch with such an attempt is not written again; if
two attempts succeed at the same time, the one with the least name counts. So a batch that failed
half-way, was sent again or ran twice counts once, and nothing committed is ever overwritten.
``compact`` (one at a time) folds the batches it lists into a new snapshot that names just these;
a batch that comes again after that is recognized and left alone. What a snapshot replaces is
deleted by the compaction after it, so readers that began before go on. Totals are the snapshot
plus the committed deltas not in it. The ids of folded batches stay a table and are never
collected; the driver lists only the batches since the last compaction but one.

Tokenizer versions are names of tokenizer files (``versions``); ``counted`` counts a text's ids by
each of them, whole and without special tokens. A batch may bring any versions.

Defined cases: null source or language is a group of its own; a null text has no tokens but
counts as a document; a change with a null count counts 0; repeated inserts of a row count as
often as they occur; totals that come to zero documents and tokens are dropped; an empty batch
commits nothing but itself; an empty table has no totals; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odonymy.llm.text import chunks
from odonymy.llm.tokens import encoder, public_path
from odonymy.session import materialize

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
COUNTED = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def versions(*names: str) -> dict[str, str]:
    """File by version name of installed public tokenizers."""
    return {name: public_path(f"{name}.json") for name in names or ("word_bpe_49k", "byte_bpe_50k")}


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """A row for each document and version: doc_id, source, lang, tokenizer_version, n_tokens."""
    files = tokenizers or versions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text").to_pylist()
            for name, path in files.items():
                n = np.diff(encoder(path)(texts)[1]) - 1  # without the end id
                yield pa.record_batch([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", *KEYS, "n_tokens"])

    text = lambda c: F.col(c).cast("string").alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("source"), text("lang"), "text").mapInArrow(run, COUNTED)


def inserted(rows: DataFrame) -> DataFrame:
    return _signed(rows, F.lit(1), F.col("n_tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    return _signed(rows, F.lit(-1), -F.col("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose count (or group) changed: the old count goes, the new one comes."""
    return deleted(old).union(inserted(new))


def _signed(rows: DataFrame, n: Column, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, n.cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals kept under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        """Names under a folder, ascending."""
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _done(self, folder: str) -> list[str]:
        """Those of them that have the success mark."""
        fs, path = self._fs()
        return [n for n in self._names(folder) if fs.exists(path(f"{self.path}/{folder}/{n}/_SUCCESS"))]

    def _held(self, snapshot: str | None) -> DataFrame:
        """Ids of the batches in a snapshot."""
        read = self.spark.read.schema("batch string")
        return read.parquet(f"{self.path}/snapshots/{snapshot}/kind=batches") if snapshot else self.spark.createDataFrame([], "batch string")

    def _snapshot(self) -> str | None:
        return (self._done("snapshots") or [None])[-1]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch under its id, if it is not there yet; False if a snapshot has it already."""
        snapshot = self._snapshot()
        if snapshot and not self._held(snapshot).where(F.col("batch") == batch).isEmpty():
            return False
        if not self._done(f"batches/{batch}"):
            _summed(deltas).write.parquet(f"{self.path}/batches/{batch}/{uuid.uuid4().hex}")
        return True

    def _listed(self, snapshot: str | None) -> tuple[dict[str, str], list[str]]:
        """One listing: (folder by id of committed batches that are not in the snapshot, ids of those that are)."""
        found = {b: done[0] for b in self._names("batches") if (done := self._done(f"batches/{b}"))}
        if not found or not snapshot:
            return found, []
        ids = self.spark.createDataFrame([(b,) for b in found], "batch string")
        old = {r.batch for r in ids.join(self._held(snapshot), "batch", "left_semi").collect()}  # at most the listed ones
        return {b: at for b, at in found.items() if b not in old}, sorted(old)

    def _totals(self, snapshot: str | None, new: dict[str, str]) -> DataFrame:
        read = self.spark.read.schema(TOTALS)
        rows = read.parquet(f"{self.path}/snapshots/{snapshot}/kind=totals") if snapshot else self.spark.createDataFrame([], TOTALS)
        if new:
            rows = rows.union(read.parquet(*(f"{self.path}/batches/{b}/{at}" for b, at in new.items())))
        return _summed(rows).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        snapshot = self._snapshot()
        return self._totals(snapshot, self._listed(snapshot)[0])

    def compact(self) -> None:
        """Folds the committed batches into a new snapshot; what the last one had replaced is deleted."""
        before = self._snapshot()
        new, old = self._listed(before)
        name = f"{int(before) + 1 if before else 0:012d}"
        at = f"{self.path}/snapshots/{name}"
        self._totals(before, new).write.mode("overwrite").parquet(f"{at}/kind=totals")
        ids = self.spark.createDataFrame([(b,) for b in sorted(new)], "batch string")
        self._held(before).union(ids).coalesce(1).write.mode("overwrite").parquet(f"{at}/kind=batches")
        fs, path = self._fs()
        fs.create(path(f"{at}/_SUCCESS"), True).close()  # the snapshot counts from here on
        for gone in [f"batches/{b}" for b in old] + [f"snapshots/{n}" for n in self._names("snapshots") if n < (before or "")]:
            fs.delete(path(f"{self.path}/{gone}"), True)


def replay(docs: DataFrame, path: str) -> DataFrame:
    """The whole table through the rollup: inserted in four batches, a seventh of it deleted and put
    back, a fifth entered with half-finished counts first and revised after; one batch sent twice,
    a compaction in between. The totals are those of the table."""
    spark = docs.sparkSession
    roll = Rollup(spark, path)
    rows = materialize(counted(docs), "token-counts")  # texts are encoded once
    early = rows.withColumn("n_tokens", F.when(F.col("doc_id") % 5 == 0, F.floor(F.col("n_tokens") / 2)).otherwise(F.col("n_tokens")).cast("long"))
    part = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(4))  # negative ids too fall into 0 to 3
    for k in range(4):
        roll.commit(f"insert-{k}", inserted(early.where(part == k)))
    roll.commit("insert-1", inserted(early.where(part == 1)))
    some = rows.where(F.col("doc_id") % 5 == 0)
    roll.commit("revise-0", revised(early.where(F.col("doc_id") % 5 == 0), some))
    roll.compact()
    roll.commit("insert-2", inserted(early.where(part == 2)))
    roll.commit("delete-0", deleted(rows.where(F.col("doc_id") % 7 == 0)))
    roll.commit("insert-4", inserted(rows.where(F.col("doc_id") % 7 == 0)))
    return roll.totals()
