"""Groups of spelling variants by search schemes over FM-indexes.

Two words are *near* if one inserted, deleted or replaced code point makes one the other.  A word's *form* is its
near word that occurs most (ties: the smallest in code-point order), if that occurs at least ``ratio`` times as
often; the *root* is where forms of forms end.

1. Words are counted in each batch of texts, then overall.
2. One error leaves one half of a word whole: either the first ``m // 2`` code points of a word of length ``m``
   begin its near word, or the others end it.  So words are dealt by first halves and by last halves (as long as
   those of words a code point shorter or longer).  What shares no half with another word is left out.  A half
   of very many words is cut into blocks by hash: each part of those who ask meets each block.
3. A bucket of blocks holds an FM-index for each direction over its delimited words: words that are to be read
   forward are indexed backward, and the other way round, so that the search extends away from the half.  An
   interval of suffix ranks starts at the delimiters, is narrowed by the half exactly and then, code point by
   code point, by the rest with one error allowed (another code point, one more, one less); it ends where the
   delimiter follows.  All words that ask are searched at once with numpy.
4. A pair found from both halves counts for the first.  A bucket returns a word's number of near words and the
   best of them, never pairs.  Roots are found by doubling the way along forms.

Defined results: a null or empty text has no words; a null ``doc_id`` is an empty text in ``noise``'s key; rows
repeated count again; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import group_arrow, map_arrow, shared_checkpoint, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK = 1 << 16  # words of one half that are indexed together
ROWS = 1 << 16  # rows of a bucket
BATCH = 1 << 13  # words searched at once
LONG = 1 << 20  # texts from this length are not listed as runs at once
KEPT = 1 << 17  # distinct words counted before they are sent


def damaged(key: int, run: str) -> str:
    """The run without one code point where the checksum says so; ``key`` is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), key)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, noise: bool = False, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words; ``noise``: words are damaged by the checksum of ``<doc_id>:<word>``."""

    def ready(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches, "text"):
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                own = Counter(RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text)))
                lower: Counter = Counter()
                for w, n in own.items():
                    lower[w.lower() if w.isascii() else w.translate(_LOWER)] += n
                key = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in lower.items():
                    if noise:
                        w = damaged(key, w)
                    if len(w) >= min_length:
                        counts[w] += n
                if len(counts) > KEPT:
                    yield ready(counts)
                    counts = Counter()
        yield ready(counts)

    found = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Index:
    """FM-index over words that are read from the left: of the words backward, each closed by a delimiter."""

    def __init__(self, words: list[np.ndarray]):
        size = np.array([len(w) for w in words], np.int64)
        text = np.zeros(int((size + 1).sum()), np.int64)
        self.end = np.cumsum(size + 1) - 1
        inner = np.ones(len(text), bool)
        inner[self.end] = False
        text[inner] = np.concatenate([w[::-1] for w in words]) if words else []
        self.n, self.words = len(text), len(words)
        # suffixes in order: by doubling, with delimiters that are all different
        rank = text + len(words)
        rank[self.end] = np.arange(len(words))
        step = 1
        while True:
            ahead = np.zeros(self.n, np.int64)
            ahead[:-step or None] = rank[step:]
            pair = rank * (int(rank.max(initial=0)) + 1) + ahead
            order = np.argsort(pair, kind="stable")
            new = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1])) if self.n else np.zeros(0, np.int64)
            rank = np.empty(self.n, np.int64)
            rank[order] = new
            step *= 2
            if not self.n or new[-1] == self.n - 1 or step >= self.n:
                break
        self.bwt = np.where(order > 0, text[order - 1], 0)
        # places by code point and rank: searching them counts the smaller ones, which is where an interval goes
        by = np.argsort(self.bwt, kind="stable")
        self.places = self.bwt[by] * (self.n + 1) + by
        self.begins = by[:len(words)]  # ranks of whole words
        self.word = np.searchsorted(self.end, order[self.begins])
        self.letters = np.unique(self.bwt[self.bwt > 0])

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ranks narrowed by one more code point each."""
        base = c * (self.n + 1)
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def following(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of interval and code point that may follow it."""
        size = hi - lo
        few = np.flatnonzero(size <= len(self.letters))
        many = np.flatnonzero(size > len(self.letters))
        span = size[few]
        at = np.repeat(lo[few] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        pair = np.repeat(few, span) << 22 | self.bwt[at]
        pair = np.unique(pair[self.bwt[at] > 0])
        return (np.concatenate([pair >> 22, np.repeat(many, len(self.letters))]),
                np.concatenate([pair & ((1 << 22) - 1), np.tile(self.letters, len(many))]))

    def near(self, asked: list[np.ndarray], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of asked word and indexed word that differ by one error behind the first ``half`` code points."""
        size = np.array([len(w) for w in asked], np.int64)
        first = np.cumsum(size) - size
        flat = np.concatenate([*asked, np.zeros(1, np.int64)])
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), self.words, np.int64)
        for j in range(int(half.max(initial=0))):
            on = np.flatnonzero((j < half) & (lo < hi))
            lo[on], hi[on] = self.extend(lo[on], hi[on], flat[first[on] + j])
        empty = np.zeros(0, np.int64)
        exact = [empty] * 3  # asked word, interval: no error yet
        wrong = [empty] * 3  # one error
        found_q, found_w = [empty], [empty]
        start = np.flatnonzero(lo < hi)
        for j in range(int(half.min(initial=0)), int(size.max(initial=-1)) + 1):
            here = start[half[start] == j]
            q, a, b = (np.concatenate(x) for x in zip(exact, (here, lo[here], hi[here])))
            inside = np.flatnonzero(j < size[q])
            s, c = self.following(a, b)
            other = (j >= size[q[s]]) | (flat[first[q[s]] + np.minimum(j, np.maximum(size[q[s]] - 1, 0))] != c)
            s, c = s[other], c[other]
            x, y = self.extend(a[s], b[s], c)
            # one code point more
            wq, wa, wb = (np.concatenate(z) for z in zip(wrong, (q[s], x, y)))
            ends = np.flatnonzero(size[wq] == j)
            for which, word in [self._whole(wq[ends], wa[ends], wb[ends])]:
                found_q.append(which)
                found_w.append(word)
            on = np.flatnonzero(size[wq] > j)
            na, nb = self.extend(wa[on], wb[on], flat[first[wq[on]] + j])
            go = na < nb
            # another code point, or one less
            replaced = j < size[q[s]]
            wrong = [np.concatenate(z) for z in zip((wq[on][go], na[go], nb[go]), (q[s][replaced], x[replaced], y[replaced]),
                                                    (q[inside], a[inside], b[inside]))]
            na, nb = self.extend(a[inside], b[inside], flat[first[q[inside]] + j])
            go = na < nb
            exact = [q[inside][go], na[go], nb[go]]
        # what reached the end of its word in the last step
        which, word = self._whole(*wrong)
        pair = np.unique(np.concatenate([*found_q, which]) * max(1, self.words) + np.concatenate([*found_w, word]))
        return pair // max(1, self.words), pair % max(1, self.words)

    def _whole(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asked and indexed words where the delimiter follows."""
        a, b = np.searchsorted(self.begins, lo), np.searchsorted(self.begins, hi)
        span = b - a
        at = np.repeat(a - (np.cumsum(span) - span), span) + np.arange(span.sum())
        return np.repeat(q, span), self.word[at]


def _codes(word: str, forward: bool) -> np.ndarray:
    x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return x if forward else x[::-1]


def _search(table: pa.Table) -> pa.Table:
    """``word, near, best_n, best`` of the words that ask in a bucket (a word may come several times)."""
    side, asks, block = (table.column(c).to_numpy() for c in ("side", "asks", "block"))
    words, count = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    out: tuple[list, ...] = ([], [], [], [])
    for s in (0, 1):
        there = np.flatnonzero((side == s) & ~asks)
        names, place = np.unique(words[there], return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[place] = count[there]
        blocks, block_no = np.unique(block[side == s], return_inverse=True)
        number = np.zeros(len(words), np.int64)
        number[side == s] = block_no
        held = np.unique(number[there] * max(1, len(names)) + place)  # words of each block
        index = Index([_codes(w, s == 0) for w in names])
        asked = np.flatnonzero((side == s) & asks)
        for lo in range(0, len(asked), BATCH):
            part = asked[lo:lo + BATCH]
            size = np.array([len(w) for w in words[part]], np.int64)
            q, w = index.near([_codes(x, s == 0) for x in words[part]], size // 2 if s == 0 else (size + 1) // 2)
            key = number[part[q]] * max(1, len(names)) + w
            at = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
            ok = (held[at] == key) if len(held) else np.zeros(len(key), bool)
            ok &= words[part[q]] != names[w] if len(q) else ok
            if s == 1:  # found from the first half already
                ok &= np.array([not y.startswith(x[:len(x) // 2]) for x, y in zip(words[part[q]], names[w])], bool)
            q, w = q[ok], w[ok]
            order = np.lexsort((w, -n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
            for col, x in zip(out, (words[part[q[first]]], np.diff(np.append(first, len(q))), n[w[first]], names[w[first]])):
                col.extend(x.tolist())
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def near_words(words: DataFrame, total: int, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words (distinct, with ``n``) that have near words."""
    m = F.length("word")
    first, last = F.floor(m / 2), F.floor((m + 1) / 2)

    def halves(side: int, key: Callable, lengths: list, own):
        return [F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), key(k)).alias("half"), (k == own).alias("asks")) for k in lengths]

    # halves of the word's own and of the neighbouring lengths
    deals = halves(0, lambda k: F.substring(F.col("word"), F.lit(1), k.cast("int")), [F.floor((m - 1) / 2), F.floor((m + 1) / 2)], first)
    deals += halves(1, lambda k: F.substring(F.col("word"), (m - k + 1).cast("int"), k.cast("int")), [F.floor(m / 2), F.floor((m + 2) / 2)], last)
    dealt = words.select("word", "n", F.explode(F.array(*deals)).alias("x")).select("word", "n", "x.*")
    sizes = dealt.groupBy("side", "half").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    dealt = dealt.join(sizes, ["side", "half"])
    each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    part = F.pmod(F.xxhash64(F.lit(7), "word"), F.col("blocks"))

    def place(asks: bool, block_no, part_no):
        return F.struct(F.lit(asks).alias("asks"), block_no.alias("block_no"), part_no.alias("part_no"))

    there = F.transform(each, lambda p: place(False, own, p))
    ask = F.when(F.col("asks"), F.transform(each, lambda b: place(True, b, part))).otherwise(F.array().cast("array<struct<asks:boolean,block_no:bigint,part_no:bigint>>"))
    spread = dealt.select("side", "half", "word", "n", F.explode(F.concat(there, ask)).alias("x"))
    spread = spread.select("side", "word", "n", "x.asks", F.xxhash64("side", "half", "x.block_no", "x.part_no").alias("block"))
    buckets = max(4, -(-6 * total // rows))
    found = group_arrow(spread.groupBy(F.pmod("block", F.lit(buckets)).alias("bucket")), _search, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("x.n")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: where following forms ends.  Each round doubles the way."""
    way = shared_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = shared_checkpoint(way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        way = longer.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 2, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of counted words (``word, n``)."""
    from roomtrace.llm.common import ship

    ship(words.sparkSession)
    words = shared_checkpoint(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, words.count(), block, rows)
    near = words.join(near, "word", "left")
    fit = F.col("best_n") >= ratio * F.col("n")
    near = shared_checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                         F.when(fit, F.col("best")).alias("form"), F.when(fit, F.col("best_n")).alias("form_n")))
    out = near.join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
