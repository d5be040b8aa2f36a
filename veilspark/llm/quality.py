"""Operator 5: a quality classifier of supervised subword embeddings.

Features of a text are its words (cut at ASCII white space), its pairs of adjacent words, and the byte n-grams of
3 to 5 inside a word, the white space beside a word counting as its edge. In a pair, a word that only repeats the
one before is written as a back reference, so that all such pairs are one feature whatever the word. Features are hashed to rows of an embedding table; a text is the
mean of its features' vectors, followed by a softmax over two outputs. Both are learned by stochastic gradient
descent in numpy on the driver, from the whole texts of at most MAX_TRAIN labelled rows (the least by a hash of their id; of
an id's texts the least); labels outside the fit are never read.

Scoring sees every byte of every text and is row-local: output and mean are linear, so each feature row shrinks
to one number once the model is fitted. A null or empty text has no features and gets the softmax of the bias.
A very long text is scored in one piece, about 100 bytes of memory a byte. Repeated rows get equal scores; rows whose label is null or that no document carries are not used; with labels
of one class only, or none, the model is its bias. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bytescan import U64, Buffer, mix64
from veilspark.llm.common import forget, held_out, pieces, string_bytes

BUCKETS = 1 << 16
DIM = 12
NGRAMS = (3, 4, 5)
MAX_TRAIN = 3000
EPOCHS = 12
LEARN = 0.3
FOLDS = 5
REPEATED = U64(0x5EED)


def white(flat: np.ndarray) -> np.ndarray:
    return (flat == 32) | ((flat >= 9) & (flat <= 13))


def feature_rows(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (start byte, embedding row) of all features of the texts laid out in ``flat``; starts ascend in each pair."""
    if not len(flat):
        return []
    buf = Buffer(flat)
    gap = white(flat)
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[offsets] = True
    blank = np.cumsum(np.concatenate(([0], gap)))
    first = ~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1])
    last = ~gap & (np.concatenate((gap[1:], [True])) | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = buf.hash(starts, ends)
    out = [(starts, (words % U64(BUCKETS)).astype(np.int32))]
    borders = np.cumsum(edge[:-1])
    if len(starts) > 1:
        together = borders[starts[1:]] == borders[starts[:-1]]
        pair = np.where(words[1:] == words[:-1], REPEATED, mix64(words[:-1] * U64(3) + words[1:]))[together]
        out.append((starts[1:][together], (pair % U64(BUCKETS)).astype(np.int32)))
    for n in NGRAMS:
        if len(flat) < n:
            continue
        at = np.arange(len(flat) - n + 1)
        inside = blank[at + n - 1] - blank[at + 1] == 0
        inside &= borders[at] == borders[at + n - 1]
        at = at[inside]
        out.append((at, (buf.hash(at, at + n) % U64(BUCKETS)).astype(np.int32)))
    return out


def _bags(batch: pa.RecordBatch, column: str):
    """For each row: its distinct embedding rows and how often each occurs."""
    flat, offsets = string_bytes(batch.column(column))
    parts = feature_rows(flat, offsets)
    cuts = [np.searchsorted(at, offsets) for at, _ in parts]
    for k in range(batch.num_rows):
        rows = [r[c[k] : c[k + 1]] for (_, r), c in zip(parts, cuts)]
        yield np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int32), return_counts=True)


class SubwordClassifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((2, DIM), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, learn: float = LEARN, seed: int = 7) -> "SubwordClassifier":
        rng = np.random.default_rng(seed)
        weights = [(rows, (counts / max(1, counts.sum())).astype(np.float32)) for rows, counts in bags]
        steps, done = max(1, epochs * len(bags)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                rate = np.float32(learn * (1 - done / steps))
                done += 1
                rows, share = weights[i]
                vectors = self.table[rows]
                mean = share @ vectors
                raw = self.out @ mean + self.bias
                p = np.exp(raw - raw.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ self.out
                self.out -= rate * np.outer(p, mean)
                self.bias -= np.float32(0.05) * rate * p
                # each feature's share is tiny, so its step is scaled to that of the mean
                self.table[rows] = vectors - (rate * len(rows)) * np.minimum(share, np.float32(4 / max(1, len(rows))))[:, None] * back
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """What each embedding row adds to the margin of label 1 over label 0, and the bias of that margin."""
        return self.table @ (self.out[1] - self.out[0]), float(self.bias[1] - self.bias[0])


def score_batch(batch: pa.RecordBatch, column: str, weights: np.ndarray, bias: float) -> np.ndarray:
    flat, offsets = string_bytes(batch.column(column))
    total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    for at, rows in feature_rows(flat, offsets):
        sums = np.concatenate(([0.0], np.cumsum(weights[rows], dtype=np.float64)))
        cut = np.searchsorted(at, offsets)
        total += sums[cut[1:]] - sums[cut[:-1]]
        count += cut[1:] - cut[:-1]
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold: those of the least hash of the id."""
    kept = labels.where(F.col(label).isNotNull() & ~held_out(id_column, FOLDS)).groupBy(id_column).agg(F.min(F.col(label).cast("int")).alias("_veil_label"))
    chosen = kept.orderBy(F.xxhash64(id_column), id_column).limit(limit)
    return docs.select(id_column, "text").join(F.broadcast(chosen), id_column).groupBy(id_column).agg(F.min("text").alias("text"), F.min("_veil_label").alias("_veil_label")).select("text", "_veil_label")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN) -> SubwordClassifier:
    data = training_rows(docs, labels, label, limit).toArrow().sort_by([("_veil_label", "ascending"), ("text", "ascending")])
    bags: list = []
    for batch in data.combine_chunks().to_batches(max_chunksize=1000):
        for piece in pieces(batch, "text"):
            bags += list(_bags(piece, "text"))
    y = np.array([int(v > 0) for v in data.column("_veil_label").to_pylist()], dtype=np.int64)
    model = SubwordClassifier()
    return model.fit(bags, y) if len(y) else model


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", threshold: float = 0.3, limit: int = MAX_TRAIN) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, limit).weights())
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        forget()
        weights, bias = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score_batch(piece, "text", weights, bias))], names=[id_column, "score"])

    scored = docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {id_type}, score double")
    return scored.select(id_column, held_out(id_column, FOLDS).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
