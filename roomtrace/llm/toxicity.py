"""Toxicity: a counterfactual-regularised classifier.

Features are the words of a text (letters of A-Z in lower case, marks at the ends removed) and their
beginnings in hashed slots, with logarithms of their counts.  The logistic regression is learned from labelled
documents.  For labelled sentences that mention a group, copies are made with the term swapped for
others of its set, and the squared difference of the two scores is added to the loss with the weight
``SWAP_WEIGHT``; a term of a group therefore cannot carry weight that its counterparts do not, and
neutral mentions of a group are not held against a text.  The sets of terms are a parameter (``GROUPS`` by
default, English); where no labelled sentence has a term of them, the penalty has nothing to act on.  A sentence
longer than ``SENTENCE`` words is cut to as many words around its first term.

Defined results: a null or empty text has the bias alone as its score; null ids are scored and never
held out nor learned from; repeated rows are scored alike; with no usable labels every score is 0.5; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import map_arrow, shared_checkpoint, slices, span_hashes, text_buffer, word_spans
from roomtrace.llm.linear import Ftrl, collect_features, labelled, per_row, score, scorer, sigmoid
from roomtrace.llm.quality import LOWER, counted

BITS = 18
TRAIN_ROWS, EPOCHS = 6000, 6  # labelled documents learned from at most, passes over them
SWAP_ROWS = 4000  # swapped sentences learned from at most
SWAP_WEIGHT = 1.0
SENTENCE = 60  # words of a sentence that is swapped
POSITIVE = 5.0  # weight of a toxic document in the loss
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
# sets of terms that name groups; a term is swapped for others of its set
GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens", "locals"),
    ("old", "young", "elderly", "teenage", "retired"),
    ("disabled", "deaf", "blind", "autistic", "healthy"),
)
Groups = tuple[tuple[str, ...], ...]
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = text_buffer(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for _ in range(3):  # up to three marks at either end
        starts = starts + (_MARK[data[np.minimum(starts, len(data) - 1)]] & (starts < ends)) if len(starts) else starts
        ends = ends - (_MARK[data[ends - 1]] & (starts < ends)) if len(ends) else ends
    full = ends > starts
    starts, ends, row = starts[full], ends[full], row[full]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    hashes, rows = [span_hashes(data, starts, ends)], [row]
    for n in BEGINNINGS:
        longer = ends - starts > n
        hashes.append(span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
        rows.append(row[longer])
    slot = np.concatenate(hashes) % np.uint64((1 << BITS) - 1) + np.uint64(1)
    rows, slot, n = counted(np.concatenate(rows), slot)
    return rows, slot, np.log2(1.0 + n)


@lru_cache(maxsize=8)
def _terms(groups: Groups) -> tuple[dict[str, tuple[str, ...]], re.Pattern]:
    """The set of each term, and the pattern that finds terms as whole words."""
    of = {t.lower(): tuple(x.lower() for x in g) for g in groups for t in g}
    return of, re.compile(r"\b(" + "|".join(re.escape(t) for t in sorted(of, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)


def swapped(text: str | None, groups: Groups = GROUPS) -> Iterator[tuple[str, str]]:
    """Sentences that mention a group, each with copies whose terms are moved on within their sets."""
    of, term = _terms(groups)
    if not of:
        return
    for m in _SENTENCE.finditer(text or ""):
        found = term.search(m[0])
        if found:
            sentence = m[0].strip()
            if len(sentence) > SENTENCE:  # perhaps too many words
                before, after = m[0][:found.start()].split(), m[0][found.start():].split()
                k = max(SENTENCE // 2, SENTENCE - len(after))
                sentence = " ".join(before[-k:] + after[:SENTENCE - min(k, len(before))]) if len(before) + len(after) > SENTENCE else sentence
            for step in (1, 2, 3):
                yield sentence, term.sub(lambda t: of[t[0].lower()][(of[t[0].lower()].index(t[0].lower()) + step) % len(of[t[0].lower()])], sentence)


def swapped_pairs(sample: DataFrame, limit: int = SWAP_ROWS, groups: Groups = GROUPS) -> list[tuple]:
    """Features of at most ``limit`` pairs of sentences from the labelled documents, those of the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            pairs = [(i, *p) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for p in swapped(t, groups)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                                             names=["doc_id", "before", "after"])

    got = map_arrow(sample, run, "doc_id long, before string, after string")
    got = got.orderBy(F.xxhash64("doc_id", "before", "after"), "doc_id", "before", "after").limit(limit).collect()
    if not got:
        return []
    sides = [per_row(*features(pa.array([r[k] for r in got])), len(got)) for k in (1, 2)]
    return list(zip(*sides))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, epochs: int = EPOCHS, swap_weight: float = SWAP_WEIGHT,
          swap_limit: int = SWAP_ROWS, groups: Groups = GROUPS) -> np.ndarray:
    """Weights from at most ``limit`` labelled documents outside the held-out fold, and at most ``swap_limit``
    pairs of their sentences that mention a group."""
    sample = shared_checkpoint(labelled(docs, labels, "toxic", limit))  # read for the features and for the sentences
    rows, pairs = collect_features(sample, features), swapped_pairs(sample, swap_limit, groups)
    model = Ftrl(1 << BITS, alpha=0.5, l1=0.5 + 0.002 * len(rows), l2=0.0)
    for _ in range(epochs):
        for at, x, y in rows:
            model.learn(at, x, y, POSITIVE if y else 1.0)
        for (a, xa), (b, xb) in pairs:
            # gradient of swap_weight * (score(a) - score(b))**2
            wa, wb = model.weights(a), model.weights(b)
            pa_, pb = sigmoid(wa @ xa), sigmoid(wb @ xb)
            gap = 2 * swap_weight * (pa_ - pb)
            model.update(a, gap * pa_ * (1 - pa_) * xa, wa)
            model.update(b, -gap * pb * (1 - pb) * xb, model.weights(b))
    return model.weights()


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = TRAIN_ROWS,
                    swap_limit: int = SWAP_ROWS, swap_weight: float = SWAP_WEIGHT, groups: Groups = GROUPS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (1 if the score is at least ``threshold``)."""
    weights = train(docs, labels, limit, swap_weight=swap_weight, swap_limit=swap_limit, groups=groups)
    return score(docs, features, weights, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = TRAIN_ROWS, text_col: str = "text",
               swap_limit: int = SWAP_ROWS, groups: Groups = GROUPS) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    scores = scorer(docs, features, train(docs, labels, limit, swap_limit=swap_limit, groups=groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pa.RecordBatch.from_arrays([x, x.field(text_col)], names=["row", "text"]) for b in batches for x in [b.column("row")])
        for b in slices(rows, "text"):
            yield b.select(["row"]).filter(pa.array(scores(b.column("text")) < threshold))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # further columns may have any name
    return map_arrow(rows, run, rows.schema).select("row.*")
