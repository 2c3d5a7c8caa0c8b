"""Logistic regression over hashed features: follow-the-regularised-leader updates, labelled samples
of bounded size, and scoring of whole tables as sparse dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import map_arrow, mix, shared_checkpoint, slices

# features of texts: ascending row numbers, slots, values
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ftrl:
    """Follow the regularised leader (proximal): sparse weights under an L1 and an L2 penalty; slot 0 is the bias."""

    def __init__(self, slots: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5):
        self.z, self.n = np.zeros(slots), np.zeros(slots)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, importance: float = 1.0) -> None:
        w = self.weights(at)
        self.update(at, importance * (sigmoid(w @ x) - y) * x, w)


def per_row(row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each of ``n`` rows, with the bias in front."""
    at = np.searchsorted(row, np.arange(n + 1))
    return [(np.append(0, slot[a:b]).astype(np.int64), np.append(1.0, value[a:b])) for a, b in zip(at, at[1:])]


def folded(id_col):
    """Remainder that keeps rows for testing: crc32 of the id as text, modulo 5 (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


TRAIN_BYTES = 256 << 20  # of the texts learned from


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
             train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled documents outside the held-out fold, of at most
    ``train_bytes`` in all, those of the
    smallest hashes of their ids; ids with contradicting labels are left out, as are null labels and ids.
    Rows equal in id and text count once; of ids with several texts, each one's first text goes before others."""
    seen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (folded(id_col) != 0))
    seen = seen.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("y"), F.max(label).alias("_most"))
    seen = seen.where(F.col("y") == F.col("_most")).drop("_most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    keys = shared_checkpoint(texts.join(F.broadcast(seen), "doc_id").select("doc_id", "text_hash", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).distinct())
    first = keys.groupBy("doc_id").agg(F.min("text_hash").alias("_first"))  # bounded by limit
    keys = keys.join(F.broadcast(first), "doc_id").orderBy(F.col("text_hash") != F.col("_first"), F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash")
    # at most ``limit`` rows are left; those beyond the bound of bytes, in the same order, are not learned from
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    chosen = keys.limit(limit).withColumn("place", F.monotonically_increasing_id()).withColumn("upto", F.sum("bytes").over(upto))
    chosen = chosen.where(F.col("upto") <= train_bytes).select("doc_id", "text_hash", "y")
    return texts.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", "y")


def collect_features(sample: DataFrame, features: Features) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Features of a bounded sample, computed in tasks and brought to the driver in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = per_row(*features(b.column("text")), b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "y", "slot", "value"])

    got = map_arrow(sample, run, "doc_id long, y double, slot array<int>, value array<float>").toArrow()
    # views of the Arrow buffers: the sample is held once
    rows = []
    for b in got.to_batches():
        slot, value = b.column("slot"), b.column("value")
        at, slots, values = slot.offsets.to_numpy(), slot.values.to_numpy(), value.values.to_numpy()
        rows += [(i, slots[s:e], values[s:e], y) for i, y, s, e in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), at, at[1:])]
    order = np.lexsort(([len(r[1]) for r in rows], [r[0] for r in rows], mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))))
    return [rows[i][1:] for i in order.tolist()]


def scorer(docs: DataFrame, features: Features, weights: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    """Scores of texts inside a task, with broadcast weights."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scores(texts: pa.Array) -> np.ndarray:
        w = held.value
        row, slot, value = features(texts)
        return sigmoid(float(w[0]) + np.bincount(row, w[slot].astype(np.float64) * value, minlength=len(texts)))

    return scores


def score(docs: DataFrame, features: Features, weights: np.ndarray, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; the weights (of fixed size) are broadcast."""
    scores = scorer(docs, features, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text")))], names=["doc_id", "score"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_arrow(cols, run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(folded("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
