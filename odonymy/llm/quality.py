"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its hashed words (a word repeated on the spot
gives the word bigram of a repeat) and of its hashed character n-grams (runs of 3 and 4 bytes
of the UTF-8 text, case kept); a softmax layer on the average
gives the class. Both are trained together by mini-batch stochastic gradient descent in
numpy, on at most ``sample`` labelled documents (whole texts).

Since averaging is linear, scoring a text needs only the product of each vector with the
output layer: one number per feature, summed over the whole text.

Defined cases: null and empty texts have no features and score by the output bias alone; with
one class only (or no example) every score is that class's base rate with one added to each
count; repeated documents score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonymy.llm.frames import id_remainder
from odonymy.llm.samples import labelled
from odonymy.llm.text import SPACE, Hasher, chunks, split, utf8

HASH = Hasher(51)
BITS = 16
GRAMS = (3, 4)
#: The word bigram of a word and itself, whichever the word.
AGAIN = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(word features, word bounds, features of each gram length by position, byte offsets)."""
    data, off = utf8(column)
    w = split(data, off, SPACE)
    shift = np.uint64(64 - BITS)
    words = HASH.ranges(data, w.starts, w.ends)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    words = (words >> shift).astype(np.int64)
    words[again] = AGAIN
    grams, wide = [], data.astype(np.uint32)
    for n in GRAMS:
        h = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + wide[i : len(wide) - n + 1 + i] + np.uint32(n)
        h *= np.uint32(0x9E3779B1)
        grams.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return words, w.bounds, grams, off


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[hi] - total[lo]


@dataclass
class Model:
    gain: np.ndarray  # of each feature: its vector times the difference of the output rows
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        words, bounds, grams, off = features(column)
        total = _sums(self.gain[words], bounds[:-1], bounds[1:])
        count = np.diff(bounds).astype(float)
        for n, g in zip(GRAMS, grams, strict=True):
            lo = np.minimum(off[:-1], len(g))
            hi = np.maximum(lo, np.minimum(off[1:] - n + 1, len(g)))
            total += _sums(self.gain[g], lo, hi)
            count += hi - lo
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        words, bounds, grams, off = features(part.column("text"))
        ids, freq = [], []
        for i in range(part.num_rows):
            f = [words[bounds[i] : bounds[i + 1]]] + [g[off[i] : max(off[i], off[i + 1] - n + 1)] for n, g in zip(GRAMS, grams, strict=True)]
            u, c = np.unique(np.concatenate(f), return_counts=True)
            ids.append(u.astype(np.uint16).tobytes())
            freq.append((c / max(1, c.sum())).astype(np.float32).tobytes())
        yield pa.record_batch([part.column("y"), pa.array(ids, pa.binary()), pa.array(freq, pa.binary())], ["y", "i", "f"])


def _views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """Arrays over a binary column's own memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        raw = memoryview(data) if data is not None else b""
        out += [np.frombuffer(raw[a:b], kind) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5_000, dim: int = 8, epochs: int = 12, batch: int = 32, rate: float = 2.0) -> Model:
    """Fits vectors and output layer on a bounded sample; see the module's text."""
    got = labelled(docs, labels, "quality", sample).mapInArrow(_bag, "y int, i binary, f binary").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    ids, freq = _views(got.column("i"), np.uint16), _views(got.column("f"), np.float32)
    rng = np.random.default_rng(5)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32).T.copy()  # a row for each dimension
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            idx = np.concatenate([ids[i] for i in pick]).astype(np.int64)
            wgt = np.concatenate([freq[i] for i in pick])
            bounds = np.concatenate([[0], np.cumsum([len(ids[i]) for i in pick])])
            mean = np.stack([_sums(table[d][idx] * wgt, bounds[:-1], bounds[1:]) for d in range(dim)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick].astype(int)] -= 1
            lr = rate * (1 - done / steps)
            down = p @ out.T
            out -= lr * mean.T @ p / len(pick) * 4
            bias -= lr * p.mean(0) * 0.1
            width = np.diff(bounds)
            for d in range(dim):
                table[d] -= lr * np.bincount(idx, np.repeat(down[:, d], width) * wgt, 1 << BITS).astype(np.float32)
            done += 1
    del got, ids, freq
    pa.default_memory_pool().release_unused()  # the sample is the driver's largest table
    return Model(((out[:, 1] - out[:, 0]) @ table).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = model.scores(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    import pyspark.sql.types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield part.filter(pa.array(model.scores(part.column("text")) >= threshold))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def digest(scored: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
