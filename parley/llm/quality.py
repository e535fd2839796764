"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing: every token has a fixed sparse vector of a few +1 and -1 entries by hash; a token's word vector is
the sum of the sparse vectors of its neighbours over the whole corpus. Tokens share ``BUCKETS`` hashed rows, so the
table has a fixed size; tasks add up their own and Spark sums them. A document is the mean and the spread of its
tokens' unit vectors. The network learns on the driver from a bounded sample of labelled rows; a temperature, fitted
on rows that it didn't learn from, calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import WordHashes, mix64, sliced, text_slices

BUCKETS, DIMS, ENTRIES = 8192, 32, 4
FEATURES = 2 * DIMS + 2
#: Labelled rows to learn from at most, picked by a hash of the id; of them one in CALIBRATE is for the temperature.
MOST_LABELLED, CALIBRATE = 20_000, 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 48, 40, 128, 3e-3, 1e-4, 11
THRESHOLD = 0.3
_MARKS = re.compile(rb"([!-/:-@\[-`{-~]+)")


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words and runs of ASCII marks, as they are written."""
    return _MARKS.sub(rb" \1 ", text).split() if text else []


def index_table() -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS, ENTRIES) positions and signs of the sparse vectors."""
    h = mix64(np.arange(1, BUCKETS * ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, ENTRIES)
    return (h % np.uint64(DIMS)).astype(np.int64), ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1


def _buckets(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' rows, and where each document's begin and end."""
    parts = [(hashes.of(tokens_of(t)) % np.uint64(BUCKETS)).astype(np.int64) for t in texts]
    ends = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), ends


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (at, sign) = WordHashes(3), index_table()
    total, n = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches, 0):
        rows, ends = _buckets(batch.column(0).cast(pa.binary()).to_pylist(), hashes)
        if len(rows) < 2:
            continue
        n += np.bincount(rows, minlength=BUCKETS)
        inside = np.ones(len(rows) - 1, bool)
        inside[ends[(ends > 0) & (ends < len(rows))] - 1] = False
        a, b = rows[:-1][inside], rows[1:][inside]
        for own, other in ((a, b), (b, a)):
            for k in range(ENTRIES):
                total += np.bincount(own * DIMS + at[other, k], sign[other, k], BUCKETS * DIMS)
    used = np.flatnonzero(n)
    table = total.reshape(BUCKETS, DIMS)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(DIMS))], names=["row", *(f"v{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The (BUCKETS, DIMS) table of unit word vectors over all of ``docs``; its size doesn't depend on them."""
    schema = "row long, " + ", ".join(f"v{i} long" for i in range(DIMS))
    sums = docs.select(F.col(text).cast("string")).mapInArrow(_neighbours, schema).groupBy("row").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIMS)))
    table = np.zeros((BUCKETS, DIMS), np.float32)
    found = sums.toArrow()
    if found.num_rows:
        table[found.column("row").to_numpy()] = np.stack([found.column(f"v{i}").to_numpy() for i in range(DIMS)], axis=1)
    return table / np.maximum(1, np.linalg.norm(table, axis=1, keepdims=True))


def pooled(texts: list[bytes | None], vectors: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """(documents, FEATURES): mean and standard deviation of each document's word vectors, the mean likeness of
    neighbours and the share of equal ones; zeros without tokens."""
    rows, ends = _buckets(texts, hashes)
    out = np.zeros((len(texts), FEATURES), np.float32)
    filled = np.flatnonzero(np.diff(ends))
    if not len(filled):
        return out
    starts, n = ends[filled], np.diff(ends)[filled, None]
    v = vectors[rows]
    mean = np.add.reduceat(v, starts, axis=0, dtype=np.float64) / n
    out[filled, :DIMS] = mean
    out[filled, DIMS : 2 * DIMS] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, starts, axis=0, dtype=np.float64) / n - mean * mean))
    # a token with the one after it; a document's last token has none
    pairs = np.zeros((len(rows), 2))
    pairs[:-1, 0], pairs[:-1, 1] = np.einsum("ij,ij->i", v[1:], v[:-1]), rows[1:] == rows[:-1]
    pairs[ends[filled + 1] - 1] = 0
    out[filled, 2 * DIMS :] = np.add.reduceat(pairs, starts, axis=0) / np.maximum(1, n - 1)
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, one output; probabilities at ``temperature``."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Trained by Adam on all but every CALIBRATE-th row, which set the temperature. Without both labels, a constant."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(SEED)
    centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    prior = (y.sum() + 1) / (len(y) + 2)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(prior / (1 - prior)))]
    held = np.arange(len(x)) % CALIBRATE == CALIBRATE - 1
    if 0 < y.sum() < len(y):
        a, b = ((x - centre) / scale)[~held], y[~held]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), BATCH):
                i = order[lo : lo + BATCH]
                h = np.tanh(a[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((a[i].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum())):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3]))
    if held.any():
        z, t = net.logits(x[held]), y[held]
        loss = lambda s: float(np.mean(np.logaddexp(0, z / s) - t * z / s))
        net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 61)), key=loss)
    return net


def _with_features(vectors):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(3)
        for batch in sliced(batches, 2):
            x = pooled(batch.column(2).cast(pa.binary()).to_pylist(), vectors.value, hashes)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc_id", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, keep=None) -> tuple[np.ndarray, Network]:  # noqa: ANN001
    """Word vectors over all ``docs(doc_id, text)`` and a network for ``labels(doc_id, label)``; of two labels of an id the least counts.

    ``keep`` is a condition on ``doc_id`` for rows that may be learned from. Labels that are null or neither 0 nor 1 are left out.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    usable = labels.where("label in (0, 1) and doc_id is not null")
    usable = (usable.where(keep) if keep is not None else usable).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = usable.count()
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < max(1, min(1_000_000, MOST_LABELLED * 950_000 // max(1, n))))
    picked = picked.limit(MOST_LABELLED) if n > MOST_LABELLED else picked  # a guard: the hash picks 5 % fewer
    sent = spark.sparkContext.broadcast(vectors)
    rows = docs.join(F.broadcast(picked.withColumnRenamed("doc_id", "_labelled")), F.col("doc_id") == F.col("_labelled")).select("doc_id", F.col("label").cast("long").alias("label"), "text")
    found = rows.mapInArrow(_with_features(sent), "doc_id long, label long, x array<float>").toArrow()
    order = np.argsort([zlib.crc32(str(i).encode()) for i in found.column("doc_id").to_pylist()], kind="stable")
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, FEATURES)[order]
    return vectors, fit(x, found.column("label").to_numpy()[order])


def scorer(spark, vectors: np.ndarray, net: Network):  # noqa: ANN001, ANN201
    """A column function of a text: the calibrated probability of label 1."""

    sent = spark.sparkContext.broadcast((vectors, net))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, (table, model) = WordHashes(3), sent.value
        for texts in batches:
            column = pa.array(texts, pa.string(), from_pandas=True).cast(pa.binary())
            del texts
            parts = [pooled(column[rows].to_pylist(), table, hashes) for rows in text_slices(column, 1_000_000)]
            del column
            pa.default_memory_pool().release_unused()
            yield pd.Series(model.probability(np.concatenate([np.zeros((0, FEATURES)), *parts])))

    return F.pandas_udf(score, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out: their labels are not learned from. Null, empty and
    blank texts get the score of a document without tokens. Rows without an id are scored and not held out. Rows that
    share an id are scored each; the least of an id's labels counts. A table without rows gives none;
    without usable labels, all get the same score. Very long texts are pooled whole. Other columns of either table are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    vectors, net = train(own, known, ~held)
    score = scorer(docs.sparkSession, vectors, net)(F.col("text"))
    return own.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
