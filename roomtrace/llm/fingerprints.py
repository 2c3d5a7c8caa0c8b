"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

A text is cut into pieces that cover all its bytes: a piece ends at a line end, and after a word whose
hash is divisible by a step (``FINE`` among the first ``FINE_WORDS`` words, ``COARSE`` behind them), so
that pieces are found again where text has been moved.  Pieces hash to leaves, the leaves of a line to
a paragraph node, ``SECTION`` paragraphs to a section node, sections to the root.  A fingerprint is the tree,
``root:sizes:sections:paragraphs:leaves`` in hexadecimal: equal roots mean equal texts.  The likeness of two
texts (Dice's measure, a leaf weighing its step) is found by walking down both trees: sections that both have
are taken whole, then paragraphs of the other sections, then leaves of the other paragraphs.
``changed_pieces`` walks down the branches that differ to the places of an edit.

The nodes of a fingerprint have as many digits as its number of leaves needs for texts with nothing in common to
share few of them by chance (one in four thousand) (``SPARE``); of two fingerprints the shorter digits count.

Defined results: a null text is an empty text (likeness of two empty texts: 1); documents follow each
other by ``doc_id``, equal ids by a hash of the text, null ids last, and the last one is followed by the
first; a single document is followed by itself; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import map_arrow, mix, slices, span_hashes, text_buffer, word_spans

FINE, COARSE, FINE_WORDS = 2, 8, 64
SECTION = 16  # paragraphs in a section
SPARE = 4096  # values of a node for each leaf of its text
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _nodes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each group of consecutive values; ``first`` has the groups' first indices."""
    size = np.diff(np.append(first, len(values)))
    place = np.arange(len(values)) - np.repeat(first, size)
    return mix(np.add.reduceat(mix(values + (place.astype(np.uint64) + np.uint64(1)) * _STEP), first) + size.astype(np.uint64))


def tree(texts: pa.Array) -> dict[str, np.ndarray]:
    """Trees of many texts as ragged arrays: leaves with their end bytes and levels, and the nodes above."""
    data, off = text_buffer(texts)
    starts, ends, first = word_spans(data, off)
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    fine = np.arange(len(starts)) - first[row] < FINE_WORDS
    cut = ends[hashes % np.where(fine, np.uint64(FINE), np.uint64(COARSE)) == 0]
    lines = np.flatnonzero(data == 10) + 1
    cuts = np.unique(np.concatenate([cut, lines, off[1:]]))
    cuts = cuts[cuts > 0]
    begin = np.append(0, cuts)[:-1]
    leaves = span_hashes(data, begin, cuts)
    leaf_row = np.searchsorted(off, begin, side="right") - 1
    # a leaf is fine where it begins within the first words of its text
    words_before = np.searchsorted(starts, begin) - first[leaf_row]
    head = np.append(True, (data[cuts[:-1] - 1] == 10) | (leaf_row[1:] != leaf_row[:-1])) if len(cuts) else np.zeros(0, bool)
    para_first = np.flatnonzero(head)
    paras = _nodes(leaves, para_first) if len(leaves) else leaves
    para_row = leaf_row[para_first]
    in_row = np.arange(len(para_row)) - np.searchsorted(para_row, para_row)
    sec_first = np.flatnonzero(in_row % SECTION == 0)
    sections = _nodes(paras, sec_first) if len(paras) else paras
    sec_row = para_row[sec_first]
    root_first = np.flatnonzero(np.append(True, np.diff(sec_row) != 0)) if len(sec_row) else sec_first
    roots = np.zeros(len(off) - 1, np.uint64)
    if len(sections):
        roots[sec_row[root_first]] = _nodes(sections, root_first)
    return {"off": off, "leaves": leaves, "end": cuts, "leaf_row": leaf_row, "fine": words_before < FINE_WORDS, "para_first": para_first,
            "paras": paras, "sec_first": sec_first, "sections": sections, "roots": roots}


def fingerprints(texts: pa.Array) -> list[str]:
    t = tree(texts)
    n_rows = len(t["roots"])
    leaf_at = np.searchsorted(t["leaf_row"], np.arange(n_rows + 1))
    para_row = t["leaf_row"][t["para_first"]]
    para_at = np.searchsorted(para_row, np.arange(n_rows + 1))
    sec_at = np.searchsorted(para_row[t["sec_first"]], np.arange(n_rows + 1))
    size = np.diff(np.append(t["para_first"], len(t["leaves"])))
    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, para_row, size)
    fine = np.append(0, np.cumsum(t["fine"]))[leaf_at]  # fine leaves come before coarse ones in each row
    digits = np.maximum(4, np.ceil(np.log2(SPARE * np.maximum(np.diff(leaf_at), 1)) / 4).astype(np.int64))

    def shown(values: np.ndarray, n: int) -> str:
        """First ``n`` digits of each value."""
        return np.frombuffer(values.astype(">u8").tobytes().hex().encode(), np.uint8).reshape(-1, 16)[:, :n].tobytes().decode()

    text = {int(w): [shown(t[k], int(w)) for k in ("sections", "paras", "leaves")] for w in np.unique(digits)}
    out = []
    for r, (root, w, most, k) in enumerate(zip(t["roots"].tolist(), digits.tolist(), longest.tolist(), np.diff(fine).tolist())):
        sec, par, leaf = text[w]
        c = max(1, (most.bit_length() + 3) // 4)  # digits of a paragraph's number of leaves
        sizes = "".join([f"{x:0{c}x}" for x in size[para_at[r]:para_at[r + 1]].tolist()])
        out.append(f"{root:016x}:{w:x}{c:x}{k:x}:{sec[w * sec_at[r]:w * sec_at[r + 1]]}:{par[w * para_at[r]:w * para_at[r + 1]]}{sizes}:"
                   f"{leaf[w * leaf_at[r]:w * leaf_at[r + 1]]}")
    return out


class _Tree:
    """A fingerprint's nodes, their first ``w`` digits each."""

    def __init__(self, mark: str, w: int):
        _, head, sections, paras, leaves = mark.split(":")
        own, c, self.fine = int(head[0], 16), int(head[1], 16), int(head[2:], 16)
        n = len(paras) // (own + c)
        sizes = paras[n * own:]
        self.sections = [sections[i:i + w] for i in range(0, len(sections), own)]
        self.paras = [paras[i:i + w] for i in range(0, n * own, own)]
        self.leaves = [leaves[i:i + w] for i in range(0, len(leaves), own)]
        ends = [0]
        for i in range(0, n * c, c):
            ends.append(ends[-1] + int(sizes[i:i + c], 16))
        self.at = ends

    def weight(self, i: int, j: int) -> int:
        """Of leaves ``i`` to ``j``."""
        k = min(max(self.fine - i, 0), j - i)
        return FINE * k + COARSE * (j - i - k)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1: the weight of the branches that both have, by that of both."""
    if a == b:
        return 1.0
    w = min(int(x[17], 16) for x in (a, b))
    x, y = _Tree(a, w), _Tree(b, w)
    total = sum(t.weight(0, len(t.leaves)) for t in (x, y))
    if not total:
        return 1.0
    common = 0
    # what is left of each tree, level by level: sections, paragraphs, leaves
    left = []
    both = Counter(x.sections) & Counter(y.sections)
    for t in (x, y):
        still, rest = both.copy(), []
        for i, h in enumerate(t.sections):
            inside = range(SECTION * i, min(SECTION * (i + 1), len(t.paras)))
            if still[h] > 0:
                still[h] -= 1
                common += t.weight(t.at[inside.start], t.at[inside.stop])
            else:
                rest.extend(inside)
        left.append(rest)
    both = Counter(x.paras[i] for i in left[0]) & Counter(y.paras[i] for i in left[1])
    for k, t in enumerate((x, y)):
        still, rest = both.copy(), []
        for i in left[k]:
            if still[t.paras[i]] > 0:
                still[t.paras[i]] -= 1
                common += t.weight(t.at[i], t.at[i + 1])
            else:
                rest.extend(range(t.at[i], t.at[i + 1]))
        left[k] = rest
    both = Counter(x.leaves[i] for i in left[0]) & Counter(y.leaves[i] for i in left[1])
    for k, t in enumerate((x, y)):
        still = both.copy()
        for i in reversed(left[k]):  # coarse leaves first
            if still[t.leaves[i]] > 0:
                still[t.leaves[i]] -= 1
                common += FINE if i < t.fine else COARSE
    return common / total


def changed_pieces(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of ``b`` that have no equal branch in ``a``: sections first, then the paragraphs of
    sections that differ, then the pieces of paragraphs that differ."""
    ta, tb = tree(pa.array([a])), tree(pa.array([b]))
    known = {k: set(ta[k].tolist()) for k in ("sections", "paras", "leaves")}
    out: list[tuple[int, int]] = []
    if ta["roots"][0] == tb["roots"][0]:
        return out
    sec = np.append(tb["sec_first"], len(tb["paras"]))
    par = np.append(tb["para_first"], len(tb["leaves"]))
    begin = np.append(0, tb["end"])
    for i in [i for i, h in enumerate(tb["sections"].tolist()) if h not in known["sections"]]:
        for j in [j for j in range(sec[i], sec[i + 1]) if int(tb["paras"][j]) not in known["paras"]]:
            for k in range(par[j], par[j + 1]):
                if int(tb["leaves"][k]) not in known["leaves"]:
                    lo, hi = int(begin[k]), int(begin[k + 1])
                    out = [*out[:-1], (out[-1][0], hi)] if out and out[-1][1] == lo else [*out, (lo, hi)]
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], marks: list[str]) -> dict[str, list]:
    """Rows of all documents but the last one, each against the document after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    new = fingerprints(pa.array(changed, pa.large_string()))
    return {"doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "fingerprint": marks[:-1], "edited_fingerprint": new,
            "near_edited": [likeness(a, b) for a, b in zip(marks, new)], "near_next": [likeness(a, b) for a, b in zip(marks, marks[1:])]}


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, and its likeness to its edited text and to the next document.

    Documents are dealt by ranges of their ids, so a document and the next one meet in a task; the
    first and the last document of each range are kept aside and meet in a join of neighbouring ranges.
    """
    from roomtrace.session import checkpoint_dir

    spark = docs.sparkSession
    names = [f.split()[0] for f in _ROW.split(", ")]
    schema = pa.schema([("range", pa.int32()), ("kind", pa.string())] + [
        (f.split()[0], {"long": pa.int64(), "string": pa.large_string(), "double": pa.float64()}[f.split()[1]]) for f in _ROW.split(", ")]
        + [("text", pa.large_string())])

    def rows(kind: str, where: int, cols: dict, text: list | None = None) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols = {"range": [where] * n, "kind": [kind] * n, "text": text or [None] * n} | {k: [None] * n for k in names} | cols
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = TaskContext.get().partitionId()
        ids, texts, marks = [], [], []
        for b in slices(batches, "text"):
            new = ["" if t is None else t for t in b.column("text").to_pylist()]
            if not ids:
                yield rows("first", where, {"doc_id": b.column("doc_id").to_pylist()[:1]}, new[:1])
            ids, texts = ids + b.column("doc_id").to_pylist(), texts + new
            marks = marks + fingerprints(pa.array(new, pa.large_string()))
            if len(ids) > 1:
                yield rows("done", where, _compare(ids, texts, marks))
                ids, texts, marks = ids[-1:], texts[-1:], marks[-1:]
        if ids:
            yield rows("last", where, {"doc_id": ids}, texts)

    def run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for i, t, u in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                for k, v in _compare([i, None], [t, u], fingerprints(pa.array([t, u], pa.large_string()))).items():
                    out[k] += v
            yield pa.RecordBatch.from_arrays([pa.array(out[k], schema.field(k).type) for k in names], names=names)

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = cols.repartitionByRange(*order).sortWithinPartitions(*order)
    path = f"{checkpoint_dir(spark).rstrip('/')}/fingerprints-{uuid.uuid4().hex}"
    map_arrow(dealt, run, "range int, kind string, " + _ROW + ", text string").write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    # one row a range: which non-empty range comes next, the first one after the last
    first = kept.where("kind = 'first'").select("range", F.col("text").alias("following"))
    around = first.select("range").withColumn("after", F.lead("range").over(Window.orderBy("range")))
    around = around.crossJoin(F.broadcast(first.agg(F.min("range").alias("lowest")))).select("range", F.coalesce("after", "lowest").alias("after"))
    ends = kept.where("kind = 'last'").select("range", "doc_id", "text").join(around, "range")
    ends = ends.join(first.withColumnRenamed("range", "after"), "after").select("doc_id", "text", "following")
    return kept.where("kind = 'done'").select(*names).unionByName(map_arrow(ends, run_ends, _ROW))
