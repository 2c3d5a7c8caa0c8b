"""Substring deduplication with prefix-partitioned suffix trees.

A window of ``n`` consecutive words of a document is a repeat if the same words also stand in a document
with a smaller id; words covered by repeats are removed.

0. Prefixes are of variable length.  ``PREFIX`` words begin with; a prefix with more than ``HOT`` windows
   behind it is lengthened to the whole window.  A sixteenth of the documents, by hash, tells the frequent
   prefixes; they are held as bits of a bitmap of fixed size.  What the sample misses or two prefixes of one
   bit only change how the work is cut, never what comes out.
1. Of the suffixes of all texts, those count that start at *anchors*: in each window the place of the
   prefix (``PREFIX`` words) with the least hash.  Equal windows have equal anchors, so anchors are a
   sparse set of suffixes (about a fifth of all) that no repeat escapes.  They are dealt by prefix.
   A prefix that occurs in one document only is a leaf next to the root and is dropped; within a batch,
   suffixes of one prefix are first reduced to the one of the smallest id.
2. The documents with prefixes left send the windows around those anchors, again dealt by the anchor's
   prefix, so that a group holds whole subtrees; windows behind a lengthened prefix go one by one, dealt by
   all their words.  Equal windows of a batch are first reduced to the smallest id.
3. In a group the subtrees grow by longer prefixes (``DEPTHS`` words): at each depth a node with
   suffixes of one document only is dropped, the others are split further.  Nodes as deep as the window
   are internal nodes with suffixes of several documents, that is repeats; the words of each suffix are
   compared with those of its node's smallest document before it is marked.
4. Marked windows go back to their documents; neighbouring ones form the maximal repeated spans.

Defined results: a null text has no words; a null ``doc_id`` counts as larger than every other; rows with
the same id never remove from each other, repeated rows are judged alike, each on its own; texts shorter
than a window lose nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import (group_arrow, map_arrow, mix, n_buckets, pack, rolling, slices, span_hashes, text_buffer, unpack,
                                  window_min_at, word_spans)

PREFIX = 4  # words of the prefix that suffixes are dealt by
HOT, SHARE = 1 << 15, 16  # windows of a prefix that stay together; one document of so many tells frequent prefixes
BITMAP = 1 << 24  # bits of the map of frequent prefixes
GROUP_BYTES = 2 << 20  # input bytes a bucket
DEPTHS = (8,)  # further depths at which nodes are checked on the way to the window's
NO_ID = (1 << 63) - 1
_GROUP = "bucket int, h array<long>, id array<long>, key array<long>, pos array<int>, n array<int>, text array<string>"


class Windows:
    """Words, windows and anchors of the rows of a slice."""

    def __init__(self, texts: pa.Array, n: int):
        self.data, off = text_buffer(texts)
        self.starts, self.ends, self.first = word_spans(self.data, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.prefix = rolling(self.words, min(PREFIX, n))
        self.anchor = window_min_at(self.prefix, n - min(PREFIX, n) + 1)  # of each window, by its first word
        self.at = np.flatnonzero(self.row[:len(self.anchor)] == self.row[n - 1:]) if len(self.row) >= n else np.zeros(0, np.int64)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (without b), joined by one space."""
        return b" ".join(self.data[self.starts[a]:self.ends[b - 1]].tobytes().split())


def _smallest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the smallest id of its value ``h``, and whether the value has more than one id."""
    if not len(h):
        return ids, np.zeros(0, bool)
    order = np.lexsort((ids, h))
    new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    size = np.diff(np.append(new, len(h)))
    least, most = np.empty_like(ids), np.empty_like(ids)
    least[order] = np.repeat(ids[order][new], size)
    most[order] = np.repeat(ids[order][new + size - 1], size)
    return least, least != most


def _by_document(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> pa.Table:
    """One row per document with its places."""
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return pa.table({"id": ids[new], "key": keys[new],
                     "pos": pa.ListArray.from_arrays(pa.array(np.append(new, len(ids)).astype(np.int32)), pa.array(pos.astype(np.int32)))})


def _groups(buckets: int, known: tuple, sent: tuple, texts: list | None = None) -> pa.RecordBatch:
    """Packed rows: ``sent`` (h, id, key, pos, n) by the bucket of h; ``known`` (id, key, pos) bypasses the
    check in buckets of its own, spread by document."""
    h, ids, keys, pos, n = sent
    k_id, k_key, k_pos = known
    zero = np.zeros(len(k_id), np.int64)
    bucket = np.concatenate([h % np.uint64(buckets), k_key.view(np.uint64) % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)
    text = pa.array((texts or [None] * len(h)) + [None] * len(k_id), pa.string())
    hashes = h.view(np.int64) if texts is None else np.zeros(len(h), np.int64)  # texts tell their hashes
    cols = pack(bucket, {"h": np.concatenate([hashes, zero]), "id": np.concatenate([ids, k_id]), "key": np.concatenate([keys, k_key]),
                         "pos": np.concatenate([pos, k_pos]).astype(np.int32), "n": np.concatenate([n, zero]).astype(np.int32), "text": text})
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def frequent_prefixes(texts: DataFrame, n: int, hot: int, share: int) -> np.ndarray:
    """Bitmap of the prefixes that probably have more than ``hot`` windows behind them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Windows(b.column("text"), n)
            h, size = np.unique(w.prefix[w.anchor[w.at]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(BITMAP)).astype(np.int64)), pa.array(size.astype(np.int64))], names=["bit", "n"])

    some = texts.where(F.pmod(F.xxhash64("id", "key"), F.lit(share)) == 0).select("text")
    found = map_arrow(some, count, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).where(F.col("n") > hot / share)
    width = 1 << 15
    rows = found.groupBy(F.floor(F.col("bit") / width).alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % width).alias("bits")).collect()
    out = np.zeros(BITMAP >> 3, np.uint8)  # at most 512 rows of 4 KB
    for r in rows:
        out[r["at"] * (width >> 3):(r["at"] + 1) * (width >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated_windows(texts: DataFrame, n: int, buckets: int, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """``id, key, pos``: first words of the windows to be removed; ``texts`` has ``id, key, text``."""
    held = texts.sparkSession.sparkContext.broadcast(frequent_prefixes(texts, n, hot, share))

    def is_hot(h: np.ndarray) -> np.ndarray:
        bit = (h % np.uint64(BITMAP)).astype(np.int64)
        return (held.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Windows(b.column("text"), n)
            at = np.unique(w.anchor[w.at])
            ids, keys = (b.column(c).to_numpy()[w.row[at]] for c in ("id", "key"))
            h, pos = w.prefix[at], at - w.first[w.row[at]]
            least, several = _smallest(h, ids)
            # of each prefix, the suffix that stands for the batch
            sent = np.flatnonzero(ids == least)
            sent = sent[np.unique(h[sent], return_index=True)[1]]
            # rows of one id may hold a prefix in several places: they all await the group's answer
            same = np.flatnonzero((ids == least) & ~several)
            sent = np.union1d(sent, same)
            if len(at):
                yield _groups(buckets, (ids[several], keys[several], pos[several]), (h[sent], ids[sent], keys[sent], pos[sent], np.zeros(len(sent), np.int64)))

    def shared_prefixes(table: pa.Table) -> pa.Table:
        h, ids, keys, pos = (unpack(table, c) for c in ("h", "id", "key", "pos"))
        if table.column("bucket")[0].as_py() < buckets:
            several = _smallest(h, ids)[1]
            ids, keys, pos = ids[several], keys[several], pos[several]
        return _by_document(ids, keys, pos)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Windows(b.column("text"), n)
            lists = b.column("pos")
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            chosen = np.zeros(len(w.words) + 1, bool)
            chosen[w.first[row] + lists.flatten().to_numpy()] = True
            at = w.at[chosen[w.anchor[w.at]]]
            ids, keys = (b.column(c).to_numpy()[w.row[at]] for c in ("id", "key"))
            h = rolling(w.words, n)[at]
            least, _ = _smallest(h, ids)
            # a window with a smaller id in this batch is marked here, once its words are compared
            later = np.flatnonzero(ids > least)
            first = {}
            for i in np.flatnonzero(ids == least)[::-1].tolist():
                first[int(h[i])] = int(at[i])
            equal = np.array([w.text(a, a + n) == w.text(first[x], first[x] + n) for a, x in zip(at[later].tolist(), h[later].tolist())], bool)
            known = later[equal] if len(later) else later
            stays = np.setdiff1d(np.arange(len(at)), known)
            pos = at - w.first[w.row[at]]
            # windows in a row with one anchor travel together
            a = at[stays]
            split = np.append(True, (a[1:] != a[:-1] + 1) | (w.anchor[a[1:]] != w.anchor[a[:-1]])) if len(a) else np.zeros(0, bool)
            alone = is_hot(w.prefix[w.anchor[a]])  # but for those behind a lengthened prefix
            split |= alone
            run = np.flatnonzero(split)
            size = np.diff(np.append(run, len(a)))
            lead = stays[run]
            text = [w.text(x, x + k + n - 1).decode() for x, k in zip(at[lead].tolist(), size.tolist())]
            if len(at):
                deal = np.where(alone[run], h[lead], w.prefix[w.anchor[at[lead]]])
                yield _groups(buckets, (ids[known], keys[known], pos[known]), (deal, ids[lead], keys[lead], pos[lead], size), text)

    def subtrees(table: pa.Table) -> pa.Table:
        ids, keys, pos = (unpack(table, c) for c in ("id", "key", "pos"))
        if table.column("bucket")[0].as_py() >= buckets:
            return _by_document(ids, keys, pos)
        size = unpack(table, "n").astype(np.int64)
        w = Windows(table.column("text").combine_chunks().flatten(), n)
        prefix = w.prefix[w.anchor[w.first[:-1]]]
        run = np.repeat(np.arange(len(ids)), size)
        step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        at, ids, keys, pos, prefix = w.first[run] + step, ids[run], keys[run], pos[run] + step, prefix[run]
        for depth in (*DEPTHS, n):  # longer prefixes, as long as a node has suffixes of several documents
            if depth <= n and len(at):
                node = mix(prefix + rolling(w.words, depth)[at])
                several = _smallest(node, ids)[1]
                at, ids, keys, pos, prefix, node = (x[several] for x in (at, ids, keys, pos, prefix, node))
        if not len(at):
            return _by_document(ids, keys, pos)
        order = np.lexsort((ids, node))
        new = np.append(True, node[order][1:] != node[order][:-1])
        marked, there = np.zeros(len(at), bool), {}
        for i, fresh in zip(order.tolist(), new.tolist()):
            if fresh:
                there = {}
            words = w.text(at[i], at[i] + n)
            marked[i] = there.setdefault(words, ids[i]) < ids[i]
        return _by_document(ids[marked], keys[marked], pos[marked])

    spec = "id long, key long, pos array<int>"
    together = F.flatten(F.collect_list("pos")).alias("pos")
    shared = group_arrow(map_arrow(texts, anchors, _GROUP).groupBy("bucket"), shared_prefixes, spec)
    shared = shared.groupBy("id", "key").agg(together)
    there = texts.join(shared, ["id", "key"])
    marked = group_arrow(map_arrow(there, windows, _GROUP).groupBy("bucket"), subtrees, spec)
    return marked.groupBy("id", "key").agg(together)


def deduplicate(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                as_written: bool = False, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space; with ``as_written``,
    texts that lose nothing stay as they are), ``removed`` (spans of removed words: start, length), and the
    columns ``keep`` of the input."""
    if n < 1:
        raise ValueError("a window has at least one word")
    texts = docs.select(*texts_columns(id_col, text_col))
    marked = repeated_windows(texts, n, n_buckets(docs, GROUP_BYTES), hot, share)
    if keep:
        texts = docs.select(*texts_columns(id_col, text_col), F.struct(*keep).alias("kept"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [])
            for text, pos in zip(b.column("text").to_pylist(), b.column("pos")):
                words = (text or "").encode().split()
                total, removed = len(words), []
                if pos.is_valid and len(pos):
                    starts = np.unique(pos.values.to_numpy())
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + n, -1)
                    edge = np.diff(np.concatenate([[0], np.cumsum(cover)[:total] > 0, [0]]).astype(np.int8))
                    removed = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()))
                    for s, k in removed[::-1]:
                        del words[s:s + k]
                for col, x in zip(out, (total, total - len(words), text if as_written and not removed else b" ".join(words).decode(), [{"start": s, "length": k} for s, k in removed])):
                    col.append(x)
            cols = [b.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                    pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))]
            names = ["id", "n_words", "n_removed", "kept_text", "removed"]
            if keep:
                cols, names = [*cols, b.column("kept")], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = texts.join(marked, ["id", "key"], "left")
    spec = "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,length:int>>"
    if keep:
        spec += ", kept " + joined.schema["kept"].dataType.simpleString()
    out = map_arrow(joined, apply, spec)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text", "removed",
                      *([F.col(f"kept.{c}").alias(c) for c in keep]))


def texts_columns(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")]
