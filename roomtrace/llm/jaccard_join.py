"""Jaccard join of documents on word shingles with signature trees.

A document's set is its distinct shingles, hashed to 64 bits.  Documents with equal sets are one class.
Two sets whose likeness is at least ``t`` share one of their first ``n - ceil(t * n) + 1`` shingles in any
fixed order (here the longest first, then by hash), so classes are dealt by these shingles; a shingle whose classes have no two
of fitting sizes is dropped.

Classes that remain are leaves of signature trees, one tree for each shared shingle: a leaf has a bitmap
of its tokens and its size, a node the OR of its children's bitmaps and their range of sizes.  Two trees
(or a tree and itself) are traversed together; a pair of nodes goes on only if the largest overlap that
its bitmaps and sizes allow can reach what its sizes demand, and if its leaves are not connected already.
Pairs of leaves that pass are candidates; a forest of them is enough.  Its components gather the whole
sets of their classes, where the same traversal verifies exact overlaps.  Verified links are contracted
to components, whose least document id is the result.

Defined results: a null or empty text has an empty set and is linked with nothing; a null ``doc_id`` takes
part as the largest id and is null in the result where nothing smaller is linked; repeated rows are in
one class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import group_arrow, map_arrow, mix, n_buckets, pack, rolling, shared_checkpoint, ship, slices, span_hashes, text_buffer, unpack, word_spans
from roomtrace.llm.graph import components
from roomtrace.llm.quality import LOWER

NO_ID = (1 << 63) - 1
FAN_OUT = 8
GROUP_BYTES = 4 << 20  # input bytes a bucket
GROUP = 4096  # classes verified together; larger components are cut into pairs of such parts


def _ordered(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of shingles, the longest ones first: long shingles are rare, so few texts share them."""
    return (h & np.uint64((1 << 56) - 1)) | ((np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(56))


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, sorted; a text of fewer words is one shingle."""
    data, off = text_buffer(texts)
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = rolling(words, k)
    inside = np.flatnonzero(row[:len(h)] == row[k - 1:]) if len(h) else np.zeros(0, np.int64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = []
    for r in short.tolist():
        x = np.uint64(n[r])
        with np.errstate(over="ignore"):
            for v in words[first[r]:first[r + 1]]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + v
        whole.append(x)
    length = np.append(0, np.cumsum(ends - starts))
    rows = np.concatenate([row[inside], short])
    values = np.concatenate([_ordered(h, length[k:] - length[:-k])[inside] if len(inside) else h[:0],
                             _ordered(mix(np.array(whole, np.uint64)), length[first[1:][short]] - length[first[:-1][short]])])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])) if len(rows) else np.zeros(0, bool)
    return rows[keep], values[keep]


def needed(a, b, pct: int):
    """Least overlap of sets of sizes a and b that makes them linked: 100 i >= pct (a + b - i)."""
    return -(-(pct * (a + b)) // (100 + pct))


def level(n: np.ndarray) -> np.ndarray:
    """Level of a set by its size: signatures double with the size, up to 64 words; beyond, half the tokens count."""
    return np.ceil(np.log2(np.maximum(n, 1) / 512)).clip(0).astype(np.int64)


def widths(n: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a set's signature at its own level, and at the next one (0 where no larger set can be linked)."""
    own = level(n)
    reaches = 100 * n >= pct * (512 << own)
    return np.where(n > 0, 8 << own.clip(0, 3), 0), np.where((n > 0) & reaches, 8 << (own + 1).clip(0, 3), 0)


def signatures(row: np.ndarray, values: np.ndarray, n: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets one after another, and where each begins (with the end last)."""
    first, second = widths(n, pct)
    start = np.append(0, np.cumsum(first + second))
    out = np.zeros(start[-1], np.uint64)
    for add, width, at in ((0, first, start[:-1]), (1, second, start[:-1] + first)):
        skip = (level(n) + add - 3).clip(0)
        r = row[width[row] > 0]
        v = values[width[row] > 0]
        chosen = ((v >> np.uint64(32)) & ((np.uint64(1) << skip[r].astype(np.uint64)) - np.uint64(1))) == 0
        r, v = r[chosen], v[chosen]
        bit = (v >> np.uint64(5)) % (np.uint64(64) * width[r].astype(np.uint64))
        np.bitwise_or.at(out, at[r] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, start


class Signatures:
    """Sizes and ragged signatures of many sets."""

    def __init__(self, size: np.ndarray, flat: np.ndarray, pct: int):
        self.size, self.flat, self.level = size, flat, level(size)
        self.first, self.second = widths(size, pct)
        self.start = np.cumsum(self.first + self.second) - self.first - self.second

    def take(self, at: np.ndarray) -> "Signatures":
        """The same for some of the sets."""
        out = object.__new__(Signatures)
        out.flat = self.flat
        for name in ("size", "level", "first", "second", "start"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def groups(self, at: np.ndarray):
        """Sets of each level, with those below that may be linked to it, and their bitmaps as a matrix."""
        for k in np.unique(self.level[at]).tolist():
            own, below = at[self.level[at] == k], at[(self.level[at] == k - 1) & (self.second[at] > 0)]
            members = np.concatenate([own, below])
            if len(members) > 1:
                begin = np.concatenate([self.start[own], self.start[below] + self.first[below]])
                yield members, self.flat[begin[:, None] + np.arange(8 << min(k, 3))]


def pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[at] = r
                return r
            r = up

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class SignatureTree:
    """Levels of OR-combined bitmaps with ranges of sizes, over leaves in the order of their sizes."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        # tokens beyond the bits of their set: so many more may overlap than common bits show
        extra = size - pop(bits)
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, x = self.levels[-1]
            first = np.arange(0, len(lo), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(b, first, axis=0), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(x, first)))

    def may_reach(self, level: int, i: np.ndarray, j: np.ndarray, pct: int) -> np.ndarray:
        """Whether pairs of nodes may hold linked leaves."""
        b, lo, hi, extra = self.levels[level]
        fits = (100 * np.minimum(hi[i], hi[j]) >= pct * np.maximum(lo[i], lo[j]))
        at = np.flatnonzero(fits)
        i, j = i[at], j[at]
        if level == 0:
            lost_i, lost_j = pop(b[i] & ~b[j]), pop(b[j] & ~b[i])
            most = np.minimum(lo[i] - lost_i, lo[j] - lost_j)
        else:
            most = np.minimum(np.minimum(hi[i], hi[j]), pop(b[i] & b[j]) + np.minimum(extra[i], extra[j]))
        fits[at] = most >= needed(lo[i], lo[j], pct)
        return fits


def connect(sets: Signatures, pct: int, forest: Forest, at: np.ndarray, verify=None, parts: np.ndarray | None = None) -> None:
    """Connect the linked (or possibly linked) sets among ``at``, level by level."""
    for members, bits in sets.groups(at):
        traverse(sets.size[members], bits, pct, forest, members, verify, parts)


def traverse(size: np.ndarray, bits: np.ndarray, pct: int, forest: Forest, at: np.ndarray, verify=None, parts: np.ndarray | None = None) -> None:
    """Dual traversal of the tree over the leaves ``at`` (places in the forest) with itself; ``size`` and
    ``bits`` are those of the leaves.

    First one leaf meets all others, which connects most of what belongs together; then the traversal
    skips what is connected.  ``verify(i, js)`` tells which of the candidates ``js`` are linked with
    ``i``; without it every candidate counts.  ``parts``: only pairs of different parts are of interest.
    """
    order = np.argsort(size, kind="stable")
    at = at[order]
    tree = SignatureTree(size[order], bits[order])

    def link(i: int, js: np.ndarray) -> None:
        if verify is not None and len(js):
            js = js[verify(int(at[i]), at[js])]
        for j in js.tolist():
            forest.join(int(at[i]), int(at[j]))

    every = np.arange(1, len(at))
    if parts is None:
        link(0, every[tree.may_reach(0, np.zeros(len(every), np.int64), every, pct)])
        if len(np.unique(forest.roots(at))) == 1:
            return

    def down(level: int, i: np.ndarray, j: np.ndarray) -> None:
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]
            fits = tree.may_reach(level, a, b, pct)
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            if level:
                n = len(tree.levels[level - 1][1])
                step = np.arange(FAN_OUT)
                ca = np.repeat((a[:, None] * FAN_OUT + step), FAN_OUT, axis=1).ravel()
                cb = np.tile((b[:, None] * FAN_OUT + step), FAN_OUT).ravel()
                ok = (ca < n) & (cb < n) & ((ca < cb) if level == 1 else (ca <= cb))
                down(level - 1, ca[ok], cb[ok])
                continue
            if parts is not None:
                ok = parts[at[a]] != parts[at[b]]
                a, b = a[ok], b[ok]
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            for s, e in zip(cuts := np.flatnonzero(np.append(True, np.diff(a) != 0)) if len(a) else [], [*cuts[1:], len(a)] if len(a) else []):
                js = b[s:e]
                js = js[forest.roots(at[js]) != forest.root(int(at[a[s]]))]
                link(int(a[s]), js)

    top = len(tree.levels) - 1
    if top:
        down(top, np.zeros(1, np.int64), np.zeros(1, np.int64))


def _edges(ids: np.ndarray, forest: Forest) -> pa.Table:
    """Every connected id with the least id of its tree: stars, which later contractions keep."""
    roots = forest.roots(np.arange(len(ids)))
    least = ids.copy()
    np.minimum.at(least, roots, ids)
    far = np.flatnonzero(ids != least[roots])
    return pa.table({"a": pa.array(ids[far], pa.int64()), "b": pa.array(least[roots[far]], pa.int64())})


def _sorted_groups(key: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(key[order][1:] != key[order][:-1]) + 1) if len(key) else []


def jaccard_components(docs: DataFrame, k: int = 3, pct: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, class_id`` (a hash that equal sets share; null for empty
    sets), ``text_hash`` and ``root`` (the least class of the component, which tells components apart where their
    least ids are null or equal; null for empty sets)."""
    from roomtrace.session import checkpoint_dir

    if not 50 <= pct <= 100:
        raise ValueError("pct is a percentage from 50 to 100: signatures meet those of their own level and the next")
    spark = docs.sparkSession
    ship(spark)
    store = f"{checkpoint_dir(spark).rstrip('/')}/jaccard-{uuid.uuid4().hex}"
    buckets = n_buckets(docs, GROUP_BYTES)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, values = shingle_sets(b.column("text"), k)
            n = np.bincount(row, minlength=b.num_rows)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            place = np.arange(len(row)) - at[row]
            total = np.append(np.uint64(0), np.cumsum(mix(values)))
            cls = mix((total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64)).view(np.int64)
            ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
            # a class sends its shingles once a batch
            sends = np.zeros(b.num_rows, bool)
            sends[np.unique(cls, return_index=True)[1]] = True
            sends &= n > 0
            prefix = np.flatnonzero((place <= n[row] - needed_prefix(n[row], pct)) & sends[row])
            r = row[prefix]
            cols = pack((values[prefix] % np.uint64(buckets)).astype(np.int64), {"token": values[prefix].view(np.int64), **{
                c: x[r] for c, x in (("cls", cls), ("id", ids), ("key", keys), ("n", n.astype(np.int32)))}})
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(cols["bucket"]) + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*cols.values(), empty], names=[*cols, "bits"])
            # the documents themselves pass by the check, in buckets behind the others
            one = np.zeros(b.num_rows, np.int64)
            cols = pack(one + buckets + int(keys.view(np.uint64)[0] % np.uint64(buckets)), {"token": one, "cls": cls, "id": ids, "key": keys, "n": n.astype(np.int32)})
            flat, _ = signatures(row, values, n, pct)
            bits = pa.ListArray.from_arrays(pa.array(np.array([0, len(flat)], np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*cols.values(), bits], names=[*cols, "bits"])

    def shared_shingles(table: pa.Table) -> pa.Table:
        token, cls, ids, keys, n = (unpack(table, c) for c in ("token", "cls", "id", "key", "n"))
        kind = int(table.column("bucket")[0].as_py() < buckets)
        if kind:
            order = np.lexsort((cls, n, token))
            token, cls, ids, keys, n = (x[order] for x in (token, cls, ids, keys, n))
            once = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])) if len(token) else np.zeros(0, bool)
            token, cls, ids, keys, n = (x[once] for x in (token, cls, ids, keys, n))
            # the nearest size is the one before or after
            fits = (token[1:] == token[:-1]) & (100 * n[:-1].astype(np.int64) >= pct * n[1:].astype(np.int64))
            keep = np.append(fits, False) | np.append(False, fits) if len(token) else np.zeros(0, bool)
            token, cls, ids, keys, n = (x[keep] for x in (token, cls, ids, keys, n))
        bits = pa.array(unpack(table, "bits")) if not kind else pa.array(np.zeros(0, np.int64))
        place = np.append(0, np.cumsum(sum(widths(n.astype(np.int64), pct)))).astype(np.int32) * (1 - kind)
        return pa.table({"kind": pa.array(np.full(len(token), kind), pa.int32()), "token": token, "cls": cls, "id": ids, "key": keys, "n": n,
                         "bits": pa.ListArray.from_arrays(pa.array(place), bits)})

    dealt = map_arrow(texts, first_shingles, "bucket int, token array<long>, cls array<long>, id array<long>, key array<long>, n array<int>, bits array<long>")
    group_arrow(dealt.groupBy("bucket"), shared_shingles, "kind int, token long, cls long, id long, key long, n int, bits array<long>") \
        .write.option("compression", "zstd").parquet(f"{store}/shingles")
    found = spark.read.parquet(f"{store}/shingles")

    # one document of each class
    classes = found.where("kind = 0 and n > 0").groupBy("cls").agg(F.min(F.struct("id", "key", "n", "bits")).alias("x"))
    classes = classes.select("cls", "x.id", "x.key", "x.n", "x.bits")

    def leaves(table: pa.Table) -> tuple[np.ndarray, Signatures]:
        size = table.column("n").to_numpy().astype(np.int64)
        return table.column("cls").to_numpy(), Signatures(size, unpack(table, "bits").view(np.uint64), pct)

    def candidates(table: pa.Table) -> pa.Table:
        """Forest of candidate pairs over the trees of a bucket of shingles."""
        cls, sets = leaves(table)
        _, place = np.unique(cls, return_inverse=True)
        ids = np.zeros(place.max() + 1, np.int64)
        ids[place] = cls
        first = np.zeros(len(ids), np.int64)
        first[place] = np.arange(len(cls))
        sets, forest = sets.take(first), Forest(len(ids))
        for group in _sorted_groups(table.column("token").to_numpy()):
            if len(group) == 2:
                i, j = place[group]
                if forest.root(int(i)) == forest.root(int(j)):
                    continue
            if len(group) > 1:
                connect(sets, pct, forest, place[group])
        return _edges(ids, forest)

    trees = found.where("kind = 1").select("token", "cls").join(classes.select("cls", "n", "bits"), "cls")
    trees = trees.withColumn("bucket", F.pmod("token", F.lit(buckets)))
    coarse = components(group_arrow(trees.groupBy("bucket"), candidates, "a long, b long"))

    # whole sets only of the classes that have candidates
    member = coarse.withColumnRenamed("node", "cls").join(classes, "cls")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, values = shingle_sets(b.column("text"), k)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "cls", "n", "bits")), lists], names=["root", "cls", "n", "bits", "items"])

    # repeated rows are one leaf
    sets = map_arrow(texts.dropDuplicates(["id", "key"]).join(member, ["id", "key"]), whole_sets, "root long, cls long, n int, bits array<long>, items array<long>")

    def verified(table: pa.Table) -> pa.Table:
        """Forest of links, component by component."""
        cls, sets = leaves(table)
        size = sets.size
        part = table.column("part").to_numpy()
        other, mine = table.column("other").to_numpy(), table.column("mine").to_numpy()
        items = unpack(table, "items")
        end = np.cumsum(size)
        start = end - size
        forest = Forest(len(cls))

        def linked(i: int, js: np.ndarray) -> np.ndarray:
            own = items[start[i]:end[i]]
            own = own[np.argsort(own)]  # signed order
            span = size[js]
            at = np.repeat(start[js] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            x = items[at]
            hit = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
            same = np.add.reduceat(hit.astype(np.int64), np.cumsum(span) - span)
            return 100 * same >= pct * (size[i] + span - same)

        key = mix(mix(table.column("root").to_numpy().view(np.uint64) + part.astype(np.uint64)) + other.astype(np.uint64))
        for group in _sorted_groups(key):
            if len(group) > 1:
                connect(sets, pct, forest, group, linked, mine if part[group[0]] != other[group[0]] else None)
        edges = _edges(cls, forest)
        cut = table.column("parts").to_numpy() > 1
        return edges.append_column("cut", pa.array(np.isin(edges.column("a").to_numpy(), cls[cut])))

    # components above the bound are cut into parts by hash, and every pair of parts meets once
    many = coarse.groupBy("root").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    member = sets.join(many, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("root", "cls", "n", "bits", "items", "mine", F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"), "parts")
    member = member.withColumn("bucket", F.pmod(F.xxhash64("root", "part", "other"), F.lit(buckets)))
    links = shared_checkpoint(group_arrow(member.groupBy("bucket"), verified, "a long, b long, cut boolean"))
    roots = links.where("not cut").select(F.col("a").alias("node"), F.col("b").alias("root"))  # stars of whole components
    if not links.where("cut").isEmpty():  # those of parts are still to be joined
        roots = roots.unionByName(components(links.where("cut")))

    rows = found.where("kind = 0").select("id", "n", "key", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    rows = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    rows = rows.join(least, "root", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return rows.select(real(F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                       real(F.coalesce("least", "id")).alias("component_id"), F.col("cls").alias("class_id"), F.col("key").alias("text_hash"), "root")


def needed_prefix(n: np.ndarray, pct: int) -> np.ndarray:
    """Least overlap of a set of size n with any set it may be linked with."""
    return -(-(n * pct) // 100)
