"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Features are words, pairs of neighbouring words and the character n-grams of words with the
white space at their ends; each is hashed to one of ``BUCKETS`` vectors. A document's vector
is the average over all its features, and a softmax gives the class. Vectors and softmax are
trained together by stochastic gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm import wordbytes as wb
from postlens.llm.sample import bounded, fold

TRAIN_DOCS = 3000  # labelled documents to learn from, at most; chosen by a hash of the id
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIM = 8
GRAMS = (3, 4)
EPOCHS = 12
BATCH = 16
RATE = 4.0
THRESHOLD = 0.7
_SAME = np.uint64(0x5A3E)  # a word that repeats the one before


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every feature, one kind of feature after another."""
    words = wb.Words(texts, wb.NOT_SPACE, lower=False)
    hashes, row = words.hashes(), words.row()
    yield _bucket(hashes), row
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, int)
    before, after = hashes[inner], hashes[inner + 1]
    pair = np.where(before == after, _SAME, before * np.uint64(3) + after)
    yield _bucket(wb.mix64(pair)), row[inner]
    space = ~wb.NOT_SPACE[words.data]
    data = np.where(space, np.uint8(32), words.data)
    place = np.repeat(np.arange(len(texts)), np.diff(words.at))
    for n in GRAMS:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        fits = place[:last] == place[n - 1 :]
        for j in range(1, n - 1):
            fits &= ~space[j : last + j]
        starts = np.flatnonzero(fits)
        total = np.full(len(starts), n, np.uint64)
        for j in range(n):
            total += wb._BYTE[data[starts + j]] * wb._SHINGLE[j]
        yield _bucket(wb.mix64(total)), place[starts]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, bucket, share): the buckets of a text and their shares of its features."""
    for part in wb.chunks(batches, "text"):
        n = part.num_rows
        key = np.concatenate([row * BUCKETS + bucket for bucket, row in features(part.column("text"))])
        cell, count = np.unique(key, return_counts=True)
        row = cell // BUCKETS
        share = count / np.bincount(row, count, minlength=n)[row]
        at = np.searchsorted(row, np.arange(n + 1))
        buckets = [(cell[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(at, at[1:], strict=False)]
        shares = [share[a:b].astype(np.float32).tobytes() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("label"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
            ["doc_id", "label", "bucket", "share"],
        )


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (BUCKETS x DIM) and softmax weights (2 x (DIM + 1), bias last) for bags of features."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((2, DIM + 1), np.float32)
    steps = EPOCHS * max(1, -(-len(bags) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            some = order[i : i + BATCH]
            ids = np.concatenate([bags[d][0] for d in some])
            share = np.concatenate([bags[d][1] for d in some])
            row = np.repeat(np.arange(len(some)), [len(bags[d][0]) for d in some])
            hidden = np.stack([np.bincount(row, share * vectors[ids, k], minlength=len(some)) for k in range(DIM)], 1)
            hidden = np.concatenate((hidden, np.ones((len(some), 1))), 1).astype(np.float32)
            logit = hidden @ weights.T
            logit -= logit.max(1, keepdims=True)
            error = np.exp(logit)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(some)), labels[some]] -= 1
            back = error @ weights[:, :DIM]
            weights -= rate / len(some) * (error.T @ hidden)
            for k in range(DIM):
                vectors[:, k] -= rate * np.bincount(ids, share * back[row, k], minlength=BUCKETS).astype(np.float32)
    return vectors, weights


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per model: its vectors and weights. The rows are the bounded sample."""
    rows = []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "label", "bucket", "share")]
        rows += list(zip(*columns, strict=True))
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1], r[2], r[3]))
    bags = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows]
    vectors, weights = fit(bags, np.array([r[1] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([vectors.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], ["vectors", "weights"]
    )


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and weights from a bounded sample of the labelled documents outside the held-out fold.

    A doc_id labelled twice takes the smaller label; labels other than 0 and 1 take no part. Of
    documents that share a doc_id one is learned from.
    """
    keys = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id").agg(F.min("quality").cast("long").alias("label"))
    )
    chosen = keys.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(TRAIN_DOCS)
    sample = bounded(docs, F.broadcast(chosen), ["doc_id"]).select("doc_id", "label", "text")
    bags = sample.mapInArrow(_bags, "doc_id long, label long, bucket binary, share binary")
    # The sample is bounded, so one task can hold it.
    model = bags.repartition(1).mapInArrow(_train, "vectors binary, weights binary").first()
    return (
        np.frombuffer(model["vectors"], np.float32).reshape(BUCKETS, DIM),
        np.frombuffer(model["weights"], np.float32).reshape(2, DIM + 1),
    )


def score(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``held_out``, ``score`` and ``predicted`` for every row.

    With two classes the softmax depends on the difference of the logits, which is the average
    over the features of one number per bucket. Null and empty texts get the bias alone.
    """
    lean = (weights[1] - weights[0]).astype(np.float64)
    per_bucket = vectors.astype(np.float64) @ lean[:DIM]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wb.chunks(batches, "text"):
            total, count = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for bucket, row in features(part.column("text")):
                total += np.bincount(row, per_bucket[bucket], minlength=part.num_rows)
                count += np.bincount(row, minlength=part.num_rows)
            value = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + lean[DIM], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(n) for n in keep], part.column("_qc_held"), pa.array(value),
                    pa.array((value >= THRESHOLD).astype(np.int32)),
                ],
                [*keep, "held_out", "score", "predicted"],
            )

    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*[docs.schema[n] for n in keep], *added])
    held = docs.select(*dict.fromkeys([*keep, "text"]), (fold(F.col("doc_id"), 4) == 2).alias("_qc_held"))
    return held.mapInArrow(label, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``; without usable labels every score is 0.5."""
    added = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c not in added] if keep is None else keep
    return score(docs, *train(docs, labels), keep)
