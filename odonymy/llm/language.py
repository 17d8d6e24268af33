"""Language identification by nearest centroid.

A text is its counts of hashed 2- and 3-byte n-grams of the UTF-8 text (Latin-1 capitals
lower-cased, other ASCII than letters read as a space, n-grams with two spaces left out),
damped by a logarithm, weighted by inverse document frequency and scaled to length 1. Each
language has several centroids: spherical k-means over a sample of its texts. A text gets the
language of the centroid with the largest cosine. Rejection by distance: a text whose cosine
lies under its centroid's ``reject`` quantile of training cosines is marked ``rejected`` (its
nearest language is still given).

Centroids and frequencies are fitted on at most ``sample`` texts, about ``per_language`` of each
language or fewer if there are many languages (whole texts, one for an id, chosen by hash of the
id). With more than ``languages`` values of `lang` the most frequent ones are learned.

Defined cases: texts that are null or hold no letter get `und`, score 0 and are rejected; with no labelled
text at all every text is `und`; repeated documents count as often as they occur; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odonymy.llm.frames import id_remainder
from odonymy.llm.samples import one_text
from odonymy.llm.text import LOWER, NONWORD, chunks, utf8

BITS = 12
DIM = 1 << BITS
#: ASCII capitals become small, ASCII bytes that are no letters become spaces.
FOLD = np.where(NONWORD[LOWER] | ((np.arange(256) >= 0x30) & (np.arange(256) < 0x3A)), 0x20, LOWER).astype(np.uint8)


def _codes(data: np.ndarray) -> list[np.ndarray]:
    data = FOLD[data]
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[accent] += 0x20
    wide, blank = data.astype(np.uint32), np.concatenate([[0], np.cumsum(data == 0x20)])
    out = []
    for n in (2, 3):
        h = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for i in range(n):
            h = h * np.uint32(257) + wide[i : len(wide) - n + 1 + i]
        h = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BITS)
        h[blank[n:] - blank[: len(blank) - n] > 1 if len(h) else slice(0)] = 0
        out.append(h.astype(np.int64))
    return out


def counts(column: pa.Array) -> np.ndarray:
    """Log-damped n-gram counts, a row for each text; n-grams never cross texts."""
    data, off = utf8(column)
    codes = _codes(data)
    out = np.zeros((len(column), DIM), np.float32)
    for i in range(len(column)):
        for n, c in zip((2, 3), codes, strict=True):
            part = c[off[i] : max(off[i], off[i + 1] - n + 1)]
            if len(part):
                out[i] += np.bincount(part, minlength=DIM)
    out[:, 0] = 0
    return np.log1p(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # least cosine accepted

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(best centroid, cosine) of each text."""
        cos = unit(counts(column) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        return best, cos[np.arange(len(best)), best]


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    """Spherical k-means; fewer centroids if there are fewer distinct texts."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[far.argmin()]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[near == j].sum(0) if (near == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit(docs: DataFrame, per_language: int = 700, k: int = 4, reject: float = 0.01, modulus: int = 5, held: int = 0, languages: int = 500, sample: int = 12_000) -> Model:
    """Fits centroids from text and language of documents whose id is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(id_remainder("doc_id", modulus) != held)
    # A language's share of ids under a hash threshold gives about as many texts as it may have, without a sort.
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    per = F.least(F.lit(per_language), F.lit(sample) / F.greatest(F.count("*").over(Window.partitionBy(F.lit(0))), F.lit(1)))
    share = counted.select("lang", F.least(F.lit(1.0), per / F.col("n")).alias("share"))  # at most ``languages`` rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = rows.select("doc_id", "lang").join(F.broadcast(share), "lang").where(place < F.col("share"))
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = one_text(docs, ids, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in chunks(batches):
            yield pa.record_batch([p.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in counts(p.column("text"))], pa.binary())], ["lang", "v"])

    got = texts.mapInArrow(run, "lang string, v binary").toArrow()
    if not got.num_rows:
        return Model([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    lang = np.array(got.column("lang").to_pylist())
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = unit(x * idf)
    names, centres, floor = [], [], []
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        c = cluster(own, k)
        cos = own @ c.T
        near, best = cos.argmax(1), cos.max(1)
        for j in range(len(c)):
            names.append(name)
            floor.append(float(np.quantile(best[near == j], reject)) if (near == j).any() else 0.0)
        centres.append(c)
    return Model(names, idf, np.vstack(centres).astype(np.float32), np.array(floor))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for p in chunks(batches, limit=1 << 20):
            for at in range(0, p.num_rows, 1000):
                q = p.slice(at, 1000)
                letters = np.array(q.column("letters").to_pylist(), bool)
                if model.languages:
                    best, cos = model.predict(q.column("text"))
                else:
                    best, cos = np.full(q.num_rows, -1), np.zeros(q.num_rows)
                cos = np.where(letters, np.clip(cos, 0, 1), 0.0)
                off = (cos < model.floor[best]) if model.languages else np.ones(q.num_rows, bool)
                name = names[np.where(letters, best, len(names) - 1)]
                yield pa.record_batch([q.column("doc_id"), pa.array(name, pa.string()), pa.array(cos.astype(float)), pa.array(off | ~letters)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def digest(predicted: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return predicted.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
