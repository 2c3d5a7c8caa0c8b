"""Language-model scoring by cross-entropy difference.

Two bigram models of the same form are counted, one over a target corpus and one over the background
corpus (all documents).  They share one vocabulary, the words of both corpora (letters of A-Z in lower
case), and count every word and every pair of neighbours, however many there are.  With ``c`` the counts
of a model, ``N`` its number of words and ``q(w)`` the share of ``w`` in both corpora together::

    p(w)     = (c(w) + MU * q(w)) / (N + MU)
    p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU)

A document's loss under a model is the mean of ``-ln p`` over its words, the first one by ``p(w)``; its
score is the loss under the target minus the loss under the background (lower: closer to the target).

The counts grow with the corpus, so they are neither collected nor broadcast.  Documents are dealt to
blocks of bounded bytes by a hash of id and place.  A block sends its distinct words and pairs (as hashes, with its own
counts) to buckets by their leading bits; a bucket sums them up and answers each block with the totals,
in the order asked.  A frequent word costs a bucket one entry a block, not one an occurrence.  The block
then scores its documents.

Defined results: a null or empty text has no tokens, losses and score 0; null ids and repeated rows are
scored as rows of their own (and counted each); with an empty target its words follow ``q``; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import begin, group_arrow, map_arrow, mix, n_buckets, pack, ship, slices, span_hashes, text_buffer, tidy, unpack, word_spans
from roomtrace.llm.mixing import WORD
from roomtrace.llm.quality import LOWER

MU = 64.0
BLOCK_BYTES = 2 << 20  # of the estimate of the input's bytes, a block
TARGET = -1  # block number of the target's counts
_ASKED = "bucket int, block int, high array<int>, low array<smallint>, n array<int>"
_TOTALS = "block int, bucket int, target array<long>, background array<long>"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word, the places of the words that have one before them, and the hash of each such pair."""
    data, off = text_buffer(texts)
    starts, ends, first = word_spans(data, off)
    word = span_hashes(LOWER[data], starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    return row, word, inner, mix(word[inner - 1] * np.uint64(3) + word[inner])


class Block:
    """Words and pairs of some texts, and the distinct ones among them in ascending order."""

    def __init__(self, batches: Iterable[pa.RecordBatch], bits: int):
        row, word, inner, pair = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        rows = words = 0
        for b in slices(batches, "text"):
            r, w, i, p = tokens(b.column("text"))
            for all_, part in ((row, r + rows), (word, w), (inner, i + words), (pair, p)):
                all_.append(part)
            rows, words = rows + b.num_rows, words + len(w)
        self.row, self.inner = np.concatenate(row), np.concatenate(inner)
        self.rest = min(48, 64 - bits)  # bits of a hash that are sent besides its bucket
        hashes = np.concatenate(word + pair) >> np.uint64(64 - bits - self.rest)
        self.key, at, self.n = np.unique(hashes, return_inverse=True, return_counts=True)
        self.word, self.pair = at[:words], at[words:]

    def asked(self, block: int) -> pa.Table:
        """One row per bucket: the distinct hashes and their counts here."""
        rest = self.key & np.uint64((1 << self.rest) - 1)
        cols = pack((self.key >> np.uint64(self.rest)).astype(np.int64), {
            "high": (rest >> np.uint64(16)).astype(np.uint32).view(np.int32), "low": rest.astype(np.uint16).view(np.int16), "n": self.n.astype(np.int32)})
        return pa.table({"bucket": cols.pop("bucket"), "block": pa.array(np.full(len(cols["n"]), block, np.int32))} | cols)

    def losses(self, count: np.ndarray, total: int, share: np.ndarray) -> np.ndarray:
        """``-ln p`` of each word under the model with these counts of the distinct hashes."""
        p = (count[self.word] + MU * share[self.word]) / (total + MU)
        before = self.word[self.inner - 1]
        p[self.inner] = (count[self.pair] + MU * p[self.inner]) / (count[before] + MU)
        return -np.log(p)


def totals(table: pa.Table) -> pa.Table:
    """A bucket's answer to each block: the counts in both corpora, in the order asked."""
    key = unpack(table, "high").view(np.uint32).astype(np.uint64) << np.uint64(16) | unpack(table, "low").view(np.uint16)
    n, size = unpack(table, "n"), pc.list_value_length(table.column("n")).to_numpy()
    block = table.column("block").to_numpy()
    from_target = np.repeat(block == TARGET, size)
    distinct, at = np.unique(key, return_inverse=True)
    counts = [np.bincount(at[x], n[x], len(distinct)).astype(np.int64)[at[~from_target]] for x in (from_target, ~from_target)]
    off = pa.array(np.append(0, np.cumsum(size[block != TARGET])).astype(np.int32))
    block = block[block != TARGET]
    bucket = np.full(len(block), table.column("bucket")[0].as_py(), np.int32)
    return pa.table({"block": block, "bucket": bucket} | {k: pa.ListArray.from_arrays(off, pa.array(c)) for k, c in zip(("target", "background"), counts, strict=True)})


def n_words(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0


def lm_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` per document; ``target`` has a column ``text``."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    target = target.select("text")
    ship(docs.sparkSession)
    total = n_words(target), n_words(cols)
    blocks = n_buckets(cols, BLOCK_BYTES)
    bits = max(4, (blocks - 1).bit_length())
    # both groupings of the texts have the same plan, so that one exchange serves the counting and the scoring;
    # the row's place tells repeated rows apart, so that they spread over the blocks
    place = F.monotonically_increasing_id()
    dealt = cols.withColumn("block", F.pmod(F.xxhash64("doc_id", place), F.lit(blocks)).cast("int"))

    def asked(table: pa.Table) -> pa.Table:
        return Block(table.to_batches(), bits).asked(table.column("block")[0].as_py())

    def asked_by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield from Block([b], bits).asked(TARGET).to_batches()

    def scored(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        begin(__name__)
        b = Block(texts.to_batches(), bits)
        answers = answers.sort_by("bucket")
        counts = [unpack(answers, k) if len(answers) else np.zeros(0, np.int64) for k in ("target", "background")]
        share = (counts[0] + counts[1]) / max(1, sum(total))
        n = np.bincount(b.row, minlength=len(texts))
        loss = [np.bincount(b.row, b.losses(c, t, share), len(texts)) / np.maximum(n, 1) for c, t in zip(counts, total, strict=True)]
        tidy()
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": n.astype(np.int64), "target_loss": loss[0], "background_loss": loss[1], "score": loss[0] - loss[1]})

    all_asked = group_arrow(dealt.groupBy("block"), asked, _ASKED).unionByName(map_arrow(target, asked_by_target, _ASKED))
    answers = group_arrow(all_asked.groupBy("bucket"), totals, _TOTALS)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
