"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-
leader updates and scored as sparse dot products.

The n-grams are single words and pairs of neighbours, as written (letters of A-Z in lower case) and as
shapes (kinds of the first two and the last two characters of a word, and whether a word repeats the one
before).  Counts enter as logarithms, scaled so that a text's features have length ``NORM``.

Defined results: a null or empty text has the bias alone as its score; null ids are scored and never held
out nor learned from; repeated rows are scored alike; with no usable labels every score is 0.5; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomtrace.llm.common import mix, span_hashes, text_buffer, word_spans
from roomtrace.llm.linear import Ftrl, collect_features, labelled, score

BITS = 18
TRAIN_ROWS, EPOCHS = 4000, 6  # labelled documents learned from at most, passes over them
NORM = 4.0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KIND = np.arange(256, dtype=np.uint64)  # marks stand for themselves
_KIND[97:123], _KIND[128:], _KIND[65:91], _KIND[48:58] = 1, 1, 2, 3


def counted(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots of each row with their counts."""
    key, n = np.unique((row.astype(np.uint64) << np.uint64(32)) | slot, return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = text_buffer(texts)
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    word = span_hashes(LOWER[data], starts, ends)
    kind, last = _KIND[data], ends - 1
    shape = kind[starts]
    for at in (np.minimum(starts + 1, last), np.maximum(last - 1, starts), last):
        shape = shape * np.uint64(256) + kind[at]
    shape = mix(shape)
    same_row = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same_row]
    shapes = mix(shape[:-1] * np.uint64(5) + shape[1:] + (word[1:] == word[:-1]).astype(np.uint64))[same_row]
    slot = np.concatenate([word, pair, shape, shapes]) % np.uint64((1 << BITS) - 1) + np.uint64(1)
    rows, slot, n = counted(np.concatenate([row, row[1:][same_row]] * 2), slot)
    value = np.log1p(n)
    length = np.sqrt(np.bincount(rows, value * value, minlength=len(off) - 1))
    return rows, slot, NORM * value / length[rows]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most ``limit`` labelled documents outside the held-out fold."""
    sample = collect_features(labelled(docs, labels, "quality", limit), features)
    model = Ftrl(1 << BITS)
    for _ in range(epochs):
        for at, x, y in sample:
            model.learn(at, x, y)
    return model.weights()


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (1 if the score is at least ``threshold``)."""
    return score(docs, features, train(docs, labels, limit), threshold)
