"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the hashed words and
word prefixes (4 to 6 bytes) it has (presence, not counts); a document's is their noisy-or, 1 - prod(1 - p). Only documents
have labels: the gradient of the bag's log-likelihood reaches the sentences through the
noisy-or, so the weights settle on the sentences that explain the label, and the sentence
scores then locate the offending ones.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; sentences end at
. ! ? and line feeds. The model is fitted on the driver by full-batch Adagrad with an L1
penalty, on at most ``sample`` labelled documents (whole texts); a word seen in fewer than
``min_df`` of them, or not ``lift`` times as often toxic as all, has no weight. A sentence without a weighted word has probability 0, so
any number of such sentences leaves a document clean. With no positive or no negative example every sentence gets
the base rate.

Defined cases: null, empty or wordless texts have no sentence with a word and score the
model's floor 0.0; repeated documents score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.frames import id_remainder
from odonymy.llm.samples import labelled
from odonymy.llm.text import LOWER, NONWORD, Hasher, chunks, split, utf8
from odonymy.session import discard, materialize

HASH = Hasher(21)
BITS = 18
#: Inflected and compounded words share their first bytes.
PREFIXES = (4, 5, 6)
STOP = np.zeros(256, bool)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Word features of a batch: words sorted by sentence, sentences by document."""

    feature: np.ndarray  # of each word occurrence and its prefixes
    word_sentence: np.ndarray
    sentence_bounds: np.ndarray  # features of sentence j: [j]:[j+1]
    doc_bounds: np.ndarray  # sentences of document i: [i]:[i+1]
    spans: np.ndarray  # first and end byte of each sentence's words, within the text


def bags(column: pa.Array) -> Bags:
    data, off = utf8(column)
    w = split(LOWER[data], off, NONWORD)
    doc = w.doc()
    stops = np.concatenate([[0], np.cumsum(STOP[data])])[w.starts] if len(w.starts) else np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    bounds = np.append(first, len(doc))
    # A word counts as itself and by its first bytes; a prefix as long as the word is the word.
    ends = np.stack([w.ends, *(np.minimum(w.ends, w.starts + n) for n in PREFIXES)], 1)
    feature = (HASH.ranges(w.data, np.repeat(w.starts, ends.shape[1]), ends.ravel()) >> np.uint64(64 - BITS)).astype(np.int64)
    spans = np.stack([w.starts[first], w.ends[bounds[1:] - 1]], 1) - off[doc[first]][:, None] if len(first) else np.zeros((0, 2), np.int64)
    return Bags(feature, np.repeat(np.cumsum(new) - 1, ends.shape[1]), bounds * ends.shape[1], np.searchsorted(doc[first], np.arange(len(off))), spans)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -20.0
    blank: float = 0.0  # of sentences without a weighted word

    def sentences(self, b: Bags) -> np.ndarray:
        """Probability of each sentence; a word counts once in a sentence."""
        heavy = np.flatnonzero(self.weights[b.feature])
        key = (b.word_sentence[heavy] << BITS) | b.feature[heavy]
        key = np.unique(key)
        n = len(b.sentence_bounds) - 1
        z = np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], n)
        evidence = np.bincount(key >> BITS, minlength=n) > 0
        return np.where(evidence, 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))), self.blank)

    def documents(self, b: Bags) -> np.ndarray:
        """Noisy-or over each document's sentences."""
        logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(self.sentences(b), 1 - 1e-12)))])
        return 1 - np.exp(logs[b.doc_bounds[1:]] - logs[b.doc_bounds[:-1]])


def _distinct(b: Bags, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentence (from 0) and feature of document i, each pair once."""
    lo, hi = b.doc_bounds[i], b.doc_bounds[i + 1]
    of = slice(b.sentence_bounds[lo], b.sentence_bounds[hi])
    key = np.unique(((b.word_sentence[of] - lo) << BITS) | b.feature[of])
    return key >> BITS, key & ((1 << BITS) - 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature: documents that have it, and toxic ones among them."""
    n = np.zeros((2, 1 << BITS), np.int64)
    for part in chunks(batches):
        b = bags(part.column("text"))
        for i, y in enumerate(part.column("y").to_pylist()):
            own = np.unique(b.feature[b.sentence_bounds[b.doc_bounds[i]] : b.sentence_bounds[b.doc_bounds[i + 1]]])
            n[0, own] += 1
            n[1, own] += y > 0
    k = np.flatnonzero(n[0])
    yield pa.record_batch({"k": k, "n": n[0, k], "p": n[1, k]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, min_df: int = 8, lift: float = 1.5, rounds: int = 600, l1: float = 5e-5) -> Model:
    """Fits on a bounded sample of labelled documents; see the module's text."""
    rows = materialize(labelled(docs, labels, "toxic", sample), "toxicity-sample")
    counts = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    model = Model()
    if not counts[0] or counts[1] in (0, counts[0]):
        model.blank = (counts[1] + 1) / (counts[0] + 2) if counts[0] else 0.0
        return model
    tally = rows.mapInArrow(_tally, "k long, n long, p long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    tally = tally.where((F.col("n") >= min_df) & (F.col("p") >= lift * counts[1] / counts[0] * F.col("n")))
    ids = np.sort(tally.select("k").toArrow().column("k").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[ids] = True
        for part in chunks(batches):
            b, out = bags(part.column("text")), []
            for i in range(part.num_rows):
                s, f = _distinct(b, i)
                out.append((s[keep[f]].astype(np.int32).tobytes(), np.searchsorted(ids, f[keep[f]]).astype(np.int32).tobytes()))
            yield pa.record_batch([part.column("y"), pa.array(np.diff(b.doc_bounds)), *(pa.array([x[j] for x in out], pa.binary()) for j in (0, 1))], ["y", "n", "s", "f"])

    got = rows.mapInArrow(run, "y int, n long, s binary, f binary").toArrow()
    discard(rows)
    y, per = got.column("y").to_numpy().astype(float), got.column("n").to_numpy()
    sent, feat = ([np.frombuffer(x, np.int32) for x in got.column(c).to_pylist()] for c in ("s", "f"))
    base = np.cumsum(per) - per
    sentence = np.concatenate([x + o for x, o in zip(sent, base.tolist(), strict=True)]).astype(np.int64)
    col = np.concatenate(feat)
    n, docs_of = int(per.sum()), np.repeat(np.arange(len(y)), per)
    evidence = np.bincount(sentence, minlength=n) > 0
    theta, bias = np.zeros(len(ids)), -10.0
    seen, seen_b, rate = np.full(len(ids), 1e-8), 1e-8, 0.5
    for _ in range(rounds):
        z = np.bincount(sentence, theta[col], n) + bias
        p = np.where(evidence, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        clean = np.bincount(docs_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        whole = np.clip(1 - np.exp(clean), 1e-9, 1)
        g = p * np.where(y > 0, -(1 - whole) / whole, 1.0)[docs_of] / len(y)
        gw, gb = np.bincount(col, g[sentence], len(ids)), g.sum()
        seen += gw**2
        seen_b += gb**2
        step = rate / np.sqrt(seen)
        theta -= step * gw
        theta = np.sign(theta) * np.maximum(np.abs(theta) - step * l1, 0)
        bias = min(bias - 0.1 * gb / np.sqrt(seen_b), -9.0)
    model.weights[ids] = theta
    model.bias = float(bias)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds to doc_id: score, predicted and the byte ranges of sentences at or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            b = bags(part.column("text"))
            p = model.sentences(b)
            logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
            s = np.clip(1 - np.exp(logs[b.doc_bounds[1:]] - logs[b.doc_bounds[:-1]]), 0, 1)
            hot = np.flatnonzero(p >= threshold)
            of = np.searchsorted(hot, b.doc_bounds)
            spans = [[{"start": int(x), "end": int(e)} for x, e in b.spans[hot[of[i] : of[i + 1]]]] for i in range(part.num_rows)]
            typ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, typ)], ["doc_id", "score", "predicted", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:long,end:long>>")


def digest(scored: DataFrame) -> DataFrame:
    """The columns of query op2."""
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
