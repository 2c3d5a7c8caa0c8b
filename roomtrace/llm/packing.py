"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a partition, in their order, are one stream of tokens.  Cuts may fall at document
ends (free), sentence ends (small penalty) and, as a last resort, at other places (larger penalty).
With ``f[j]`` the least cost of packing the stream up to candidate cut ``j`` at position ``p[j]``::

    f[j] = penalty[j] + min over i with p[j] - max_len <= p[i] < p[j] of  f[i] + max_len - (p[j] - p[i])

The minimum of ``f[i] + p[i]`` over the sliding range comes from a monotone queue, so a block of
candidates costs linear time.  The stream is handled in blocks of bounded bytes; the last, still open
window of a block is carried into the next one.  The last window of a partition may be split into
lengths that are powers of two, which need no padding.

Defined results: a null or empty text is the end token alone; documents of any length are cut, every
token lies in exactly one piece; null ``doc_id`` and repeated rows are packed as rows of their own; an
empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import map_arrow, remembered, slices
from roomtrace.llm.token_counts import MergeTable

REMEMBER = 1_000_000  # words that a worker remembers before it starts afresh
SENTENCE, INSIDE = 2.0, 24.0  # penalties of cuts, in tokens of padding
GRID = 512  # distance of last-resort cuts
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, padding long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Latin letters that are their own normal form and lower-case letter by letter, then ASCII marks
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-/:-@\\[-`{-~]*)").fullmatch


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are the ids of
    its words one after another.  Letters with closing marks are two parts, as the tokenizer splits
    them there.  New parts of plain Latin letters are merged together in one ragged array; all others
    go through the tokenizer.  Words are remembered up to a bound.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = MergeTable(path)
        self.known: dict[bytes, bytes] = {}
        self.mark = lru_cache(maxsize=4096)(lambda c: self._encode([c])[0])
        self.stops = np.array([np.frombuffer(self.mark(c), np.uint32)[-1] for c in ".!?"], np.uint32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        ids, sizes = self.merges.merge([w.encode() for w in words])
        raw, at = ids.astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, new: set[bytes]) -> None:
        split = {}
        plain: set[str] = set()
        other: set[str] = set()
        for w in new:
            m = _PLAIN(t := w.decode())
            if m:
                mark = self.mark(m[2])
                t = m[1].lower()
                plain.add(t)
            else:
                mark = b""
                other.add(t)
            split[w] = (t, mark)
        parts = dict(zip(plain, self._merge(list(plain)))) | dict(zip(other, self._encode(list(other))))
        self.known.update((w, parts[t] + m) for w, (t, m) in split.items())

    def __call__(self, texts: list[bytes]) -> list[list[bytes]]:
        """The ids of each text, as a list of the bytes of its words."""
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        get = self.known.get
        out = [list(map(get, ws)) for ws in split]
        # only words that are not remembered are gathered, learned and filled in
        missing = [[j for j, b in enumerate(ids) if b is None] for ids in out]
        new = {ws[j] for ws, at in zip(split, missing) if at for j in at}
        self._learn(new)
        for ws, ids, at in zip(split, out, missing):
            for j in at:
                ids[j] = self.known[ws[j]]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, total: int, max_len: int) -> list[int]:
    """Cuts of least cost for a stream of ``total`` tokens: ``pos`` (increasing, within 1..total, steps
    of at most ``max_len``, ends with ``total``) and the penalty of each; returns the chosen positions."""
    best, back = [0.0], [0]
    p = [0, *pos.tolist()]
    queue: deque[int] = deque([0])
    for j, (at, cost) in enumerate(zip(p[1:], penalty.tolist()), 1):
        while p[queue[0]] < at - max_len:
            queue.popleft()
        i = queue[0]
        f = cost + best[i] + max_len - (at - p[i])
        best.append(f)
        back.append(i)
        key = f + at
        while queue and best[queue[-1]] + p[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, max_len: int, inside: float = INSIDE) -> list[int]:
    """Lengths for a last window of ``n`` tokens: powers of two while a cut costs less than padding."""
    out = []
    while n:
        top = 1 << (n.bit_length() - 1)
        if n == top or max_len - n <= inside:
            return [*out, n]
        out.append(top)
        n -= top
    return out


class Packer:
    """Packs one partition's stream; ``add`` takes documents, ``finish`` closes the last window."""

    def __init__(self, first_id: int, max_len: int, stops: np.ndarray):
        self.next_id, self.max_len, self.stops = first_id, max_len, stops
        self.ids = np.zeros(0, np.uint32)  # tokens not yet in a closed window
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, tokens, its start in self.ids (negative: begun before)

    def add(self, doc_ids: list, parts: list[list[bytes]], end: bytes) -> list[tuple]:
        at, chunks = len(self.ids), []
        for d, ws in zip(doc_ids, parts):
            ws.append(end)
            b = b"".join(ws)
            chunks.append(b)
            self.docs.append((d, len(b) // 4, at))
            at += len(b) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(chunks), "<u4")])
        total = len(self.ids)
        # the cheapest kind of cut wins where kinds coincide
        ends = np.array([s + n for _, n, s in self.docs], np.int64)
        sentence = np.flatnonzero(np.isin(self.ids[:-1], self.stops)) + 1
        step = min(GRID, self.max_len)
        grid = np.arange(step, total, step)
        penalty = np.full(total + 1, np.inf, np.float32)
        penalty[grid] = INSIDE
        penalty[sentence] = SENTENCE
        penalty[ends] = 0
        penalty[0] = np.inf
        pos = np.flatnonzero(penalty < np.inf)
        cuts = choose_cuts(pos, penalty[pos], total, self.max_len)
        return self._close(cuts[:-1])

    def finish(self) -> list[tuple]:
        return self._close(np.cumsum(tail_lengths(len(self.ids), self.max_len)).tolist())

    def _close(self, cuts: list[int]) -> list[tuple]:
        """Pieces of the windows that end at ``cuts``; what lies behind the last one stays open."""
        out, k, a = [], 0, 0
        raw = memoryview(np.ascontiguousarray(self.ids).view(np.uint8))
        for b in cuts:
            n = b - a
            pad = 0 if n & (n - 1) == 0 else self.max_len - n
            while k < len(self.docs) and self.docs[k][2] < b:
                d, size, s = self.docs[k]
                lo, hi = max(a, s), min(b, s + size)
                out.append((d, lo - s, hi - lo, zlib.crc32(raw[4 * lo:4 * hi]), size, self.next_id, lo - a, n, pad))
                if s + size > b:
                    break
                k += 1
            self.next_id += 1
            a = b
        self.docs = [(d, size, s - a) for d, size, s in self.docs[k:]]
        self.ids = self.ids[a:]
        return out


def pack_documents(docs: DataFrame, max_len: int = 4096, end_id: int = 2, path: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows of at most ``max_len`` tokens (columns of ``SCHEMA``).

    Each input partition packs its own documents; window numbers hold the partition's number in the
    high bits, so they are unique without coordination.  Nothing is shuffled.
    """
    path = path or default_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        remembered(__name__, encoder.cache_clear)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, max_len, enc.stops)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in slices(batches, "text"):
            texts = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield rows(packer.add(b.column("doc_id").to_pylist(), enc(texts), end))
        yield rows(packer.finish())

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(cols, run, SCHEMA)
