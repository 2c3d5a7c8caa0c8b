"""Token counts of a byte-level BPE by rank-synchronous merging.

Texts are cut into pre-tokens with the tokenizer's pattern.  The distinct pre-tokens of a batch are
held as one ragged numpy array of symbols; in each round every sequence applies its own lowest-rank
pair at all its places at once, until no sequence has a pair left.  The surviving symbols are the
tokens.  A very long pre-token (an unspaced run) goes through the same rounds alone, looking only beside the
places that the last one merged.  Counts of pre-tokens are remembered up to a bound, per task.

Defined results: null text counts as empty (0 tokens, 0 bytes); null ``doc_id`` and repeated rows
are passed through, one output row per input row; an empty table gives an empty result; further
columns of the input are ignored.  The strings of added special tokens inside a text count one token,
as the library does by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import map_arrow, remembered, slices

LONG = 512  # bytes of a pre-token from which it is merged on its own
REMEMBER = 400_000  # pre-tokens a task remembers before it starts afresh
_NONE = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1
    characters stand for themselves, the rest for the characters from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class MergeTable:
    """Merges of a byte-level BPE as arrays: pair -> rank, rank -> merged symbol."""

    BITS = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = merged
        # ranks by hashed pair; pairs that share a slot are found in a sorted overflow array
        slot = self._slot(key)
        crowded = np.bincount(slot, minlength=1 << self.BITS) > 1
        alone = ~crowded[slot]
        self.slot_key = np.full(1 << self.BITS, -1, np.int64)
        self.slot_rank = np.full(1 << self.BITS, _NONE)
        self.slot_key[slot[alone]], self.slot_rank[slot[alone]] = key[alone], np.flatnonzero(alone)
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(key[rest], kind="stable")]
        self.slot_key[slot[rest]] = -2
        self.rest_key, self.rest_rank = np.append(key[rest], np.iinfo(np.int64).max), np.append(rest, 0)
        symbols = [s for _, s in sorted(_byte_symbols().items())]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        self.of_last_byte = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest number where there is no such merge."""
        slot = self._slot(key)
        there = self.slot_key[slot]
        rank = np.where(there == key, self.slot_rank[slot], _NONE)
        crowded = np.flatnonzero(there == -2)
        at = np.searchsorted(self.rest_key, key[crowded])
        rank[crowded] = np.where(self.rest_key[at] == key[crowded], self.rest_rank[at], _NONE)
        return rank

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in each non-empty byte string after all merges."""
        return self.merge(tokens)[1]

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all the strings, one string after another, and how many each has."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if not long:
            return self._merge_short(tokens)
        apart = set(long)
        ids, sizes = self._merge_short([t for i, t in enumerate(tokens) if i not in apart])
        short = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        parts = [self._merge_long(t) if i in apart else next(short) for i, t in enumerate(tokens)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _merge_long(self, token: bytes) -> np.ndarray:
        """Symbols of one long string.  The places of each rank are kept, lowest rank first, and a merge asks for
        new ranks beside the places merged only, so a round costs what it changes, not the string's length."""
        raw = np.frombuffer(token, np.uint8)
        n = len(raw)
        ids = self.of_byte[raw]
        ids[-1] = self.of_last_byte[raw[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, alive = np.full(n, _NONE), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            """Rank the pairs that begin at some places."""
            at = at[after[at] < n]
            found = self.rank_of(ids[at] * self.size + ids[after[at]])
            rank[at] = found
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found
            for r, part in zip(found[first].tolist(), np.split(at, first[1:])):
                if r != _NONE:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(heap, r)
                    places[r].append(part)

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            # of overlapping places (a run of one symbol) every second one, from the left
            run = np.append(True, at[1:] != after[at[:-1]]) if len(at) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            alive[gone], ids[at], rank[at] = False, self.merged[r], _NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            look(np.union1d(at, left[left >= 0]))
        return ids[alive]

    def _merge_short(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.of_byte[raw]
        last = np.cumsum(out) - 1
        ids[last] = self.of_last_byte[raw[last]]
        live, sizes = np.arange(len(tokens)), out.copy()
        ready: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], live[:0])]
        while len(ids):
            starts = np.append(0, np.cumsum(sizes)[:-1])
            owner = np.repeat(np.arange(len(live)), sizes)
            rank = np.full(len(ids), _NONE)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank_of(ids[:-1] * self.size + ids[1:]), _NONE)
            lowest = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == lowest[owner]) & (rank != _NONE))
            # of overlapping places (a run of one symbol) every second one, from the left
            run = np.append(True, np.diff(hit) != 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            gone = np.zeros(len(ids), bool)
            gone[hit + 1] = True
            more = lowest != _NONE
            sizes = sizes - np.bincount(owner[hit], minlength=len(live))
            out[live] = sizes
            done = ~more[owner]
            ready.append((ids[done], live[owner[done]]))
            keep = ~gone & more[owner]
            ids, live, sizes = ids[keep], live[more], sizes[more]
        ids, owner = map(np.concatenate, zip(*ready))
        return ids[np.argsort(owner, kind="stable")], out


class Counter:
    """Tokens of texts, with a bounded memory of pre-token counts."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.table = MergeTable(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        n, found = [], []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            n.append(len(parts) - 1)
            found.append([x for p in parts for x in self.find(p)] if len(parts) > 1 else self.find(t))
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = set().union(*found)
        if new:
            new = list(new)
            self.known.update(zip(new, self.table.counts([x.encode() for x in new]).tolist()))
        get = self.known.__getitem__
        return [k + sum(map(get, f)) for k, f in zip(n, found)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter: tasks that run in one Python worker share what it remembers."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        remembered(__name__, counter.cache_clear)
        for b in slices(batches, "text"):
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(cols, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
