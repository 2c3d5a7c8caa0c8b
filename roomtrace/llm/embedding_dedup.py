"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Two vectors link when their cosine is at least ``t``.

1. Equal vectors are one class, counted before anything is compared.
2. Classes are dealt to cells by the nearest of a few pivots (unit vectors far apart, from a bounded sample;
   the sample only decides how the work is cut).  A unit vector linked with ``x`` lies within
   ``sqrt(2 - 2 t)`` of it, so it can lie at most that far behind the plane between its own pivot and that of
   ``x``: each class visits the cells of smaller number whose plane is so near.  Every linked pair thus meets
   in exactly one cell.
3. A cell's own classes and its visitors are cut into tiles by hash; each pair of tiles is a group of bounded
   size.  In a group unit vectors are quantised to int8 with a scale of their own; ``e`` is the measured length
   of what quantisation lost.  Integer products of tiles are exact (through float matrix products of small
   integers), and the cosine of a pair differs from its scaled product by at most ``e_i + e_j + e_i e_j``.  A
   pair above ``t`` by more than that is linked, one below by more is not, and only the pairs between are
   computed again from the vectors in double precision.
4. A group returns, for each class that has links, how many rows it is linked with and the least class of its
   tree in the group, never pairs.  Counts are summed; the stars are contracted to components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
equal vectors always link; vectors of different dimension never do; a null id counts as the largest and is a
null ``component_id`` where nothing smaller is linked; rows repeated with id and vector are vectors of their
own and link with each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import group_arrow, map_arrow, shared_checkpoint
from roomtrace.llm.graph import components

NO_ID = (1 << 63) - 1
TILE = 16384  # classes of a tile, fewer where vectors are long
TILE_BYTES = 16 << 20
SAMPLE, SAMPLE_BYTES = 1024, 16 << 20  # classes that pivots are chosen from
PIVOTS = 256
CELLS = 1024  # products looked at once: this many thousand
SLACK = 1e-9  # above all rounding in double precision
EXACT = 1 << 24  # integers up to here are exact in single precision


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Quantised:
    """Unit vectors as integers from -127 to 127 with a scale and an error bound each."""

    def __init__(self, u: np.ndarray):
        self.scale = np.abs(u).max(axis=1) / 127
        codes = np.rint(u / self.scale[:, None])
        self.error = np.sqrt(((u - codes * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12
        self.codes = codes.astype(np.float32 if u.shape[1] * 127 * 127 < EXACT else np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``, in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def linked_pairs(a: np.ndarray, b: np.ndarray | None, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places ``i`` in ``a`` and ``j`` in ``b`` (None: ``a`` itself, ``i < j``) of all linked pairs, in parts,
    and how many of a part were computed again."""
    own = b is None
    qa = Quantised(unit(a))
    qb = qa if own else Quantised(unit(b))
    b = a if own else b
    scale = qb.scale.astype(qb.codes.dtype)
    worst = qb.error.max(initial=0)
    least = (t - qa.error - worst - qa.error * worst - 1e-5) / qa.scale
    step = max(1, CELLS * 1000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        first = lo if own else 0
        products = qa.codes[lo:lo + step] @ qb.codes[first:].T
        i, j = np.nonzero(products * scale[first:] >= least[lo:lo + step, None].astype(scale.dtype))
        whole = products[i, j].astype(np.float64)
        i, j = i + lo, j + first
        if own:
            later = j > i
            i, j, whole = i[later], j[later], whole[later]
        about = whole * qa.scale[i] * qb.scale[j]
        error = qa.error[i] + qb.error[j] + qa.error[i] * qb.error[j] + SLACK
        sure = about - error >= t
        unsure = np.flatnonzero(~sure & (about + error >= t))
        for at in range(0, len(unsure), 1 << 14):
            part = unsure[at:at + (1 << 14)]
            sure[part] = cosines(a[i[part]], b[j[part]]) >= t
        if sure.any() or len(unsure):
            yield i[sure], j[sure], len(unsure)


def roots(parent: np.ndarray) -> np.ndarray:
    """Root of every place of a forest; paths are shortened on the way."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each pair of places."""
    while len(i):
        r = roots(parent)
        a, b = np.minimum(r[i], r[j]), np.maximum(r[i], r[j])
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(parent, b[apart], a[apart])


def tile_links(table: pa.Table, t: float) -> pa.Table:
    """``node, links, root`` of the classes of a group that have links."""
    node, n, tile = (table.column(c).to_numpy() for c in ("node", "n", "tile"))
    v = _matrix(table.column("v"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left = np.flatnonzero(tile == lo)
    right = left if lo == hi else np.flatnonzero(tile == hi)
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    if len(left) and len(right):
        for i, j, _ in linked_pairs(v[left], None if lo == hi else v[right], t):
            i, j = left[i], right[j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            join(parent, i, j)
    least = np.full(len(node), NO_ID)
    np.minimum.at(least, roots(parent), node)
    some = np.flatnonzero(links > 0)
    return pa.table({"node": node[some], "links": links[some], "root": least[parent[some]]})


def _matrix(col) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float64)


def pivots_of(sample: list[list[float]], n: int) -> dict[int, np.ndarray]:
    """At most ``n`` unit vectors of a sample, each as far as can be from those before, by dimension."""
    out = {}
    for d in sorted({len(v) for v in sample}):
        u = unit(np.array([v for v in sample if len(v) == d], np.float64))
        chosen, near = [0], u @ u[0]
        while len(chosen) < min(n, len(u)) and near.min() < 1 - 1e-6:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, u @ u[chosen[-1]])
        out[d] = u[chosen]
    return out


def visits(v: np.ndarray, pivots: np.ndarray, t: float) -> tuple[np.ndarray, list[list[int]]]:
    """Home cell of each vector, and the cells before it that may hold vectors linked with it."""
    near = unit(v) @ pivots.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))
    reach = np.sqrt(2 - 2 * t) + SLACK
    at = near[np.arange(len(v)), home][:, None] - near <= reach * gap[home] + SLACK
    at &= np.arange(len(pivots)) < home[:, None]
    return home, [np.flatnonzero(row).tolist() for row in at]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                    tile: int = TILE) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vec_col).cast(kind).alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", "v", F.coalesce(fine, F.lit(False)).alias("fine"))
    keyed = rows.where("fine").withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = shared_checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))

    total, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (longest or 1))))
    sample = [r["v"] for r in classes.orderBy("h1", "h2").select("v").limit(bound).collect()]
    held = spark.sparkContext.broadcast(pivots_of(sample, 1 if total <= tile else min(PIVOTS, 2 * -(-total // tile))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class at home and where it visits."""
        for b in batches:
            size = b.column("v").value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                for lo in range(0, len(at), 1024):
                    part = b.take(pa.array(at[lo:lo + 1024]))
                    home, seen = np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)]
                    if d in held.value:
                        home, seen = visits(_matrix(part.column("v")), held.value[d], threshold)
                    where = [[h, *s] for h, s in zip(home.tolist(), seen)]
                    cells = pa.array([d * (1 << 16) + c for w in where for c in w], pa.int64())
                    visitor = pa.array([k > 0 for w in where for k in range(len(w))], pa.bool_())
                    copy = part.take(pa.array(np.repeat(np.arange(part.num_rows), [len(w) for w in where])))
                    yield pa.RecordBatch.from_arrays([cells, visitor, copy.column("node"), copy.column("n"), copy.column("v")],
                                                     names=["cell", "visitor", "node", "n", "v"])

    dealt = map_arrow(classes.select("node", "n", "v"), deal, f"cell long, visitor boolean, node long, n long, v {kind}")
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / (8 * F.shiftright("cell", 16)))))
    sizes = dealt.groupBy("cell").agg(F.count(F.when(~F.col("visitor"), 1)).alias("own"), F.count(F.when(F.col("visitor"), 1)).alias("others"))
    # a row a cell: pivots, or a dimension that no pivot has
    sizes = sizes.select("cell", F.ceil(F.col("own") / room).alias("own"), F.ceil(F.col("others") / room).alias("others"))
    placed = dealt.join(sizes, "cell").where("own > 0")
    spread = F.xxhash64("node")
    placed = placed.withColumn("tile", F.when(F.col("visitor"), F.col("own") + F.pmod(spread, F.greatest("others", F.lit(1)))).otherwise(F.pmod(spread, "own")))
    last = F.when(F.col("visitor"), F.col("own")).otherwise(F.col("own") + F.col("others")) - 1
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    placed = placed.select("cell", F.least("tile", "with").alias("lo"), F.greatest("tile", "with").alias("hi"), "tile", "node", "n", "v")
    found = group_arrow(placed.groupBy("cell", "lo", "hi"), lambda table: tile_links(table, threshold), "node long, links long, root long")
    found = shared_checkpoint(found)

    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    named = classes.select("h1", "h2", "id", "n", "node").join(whole, "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = named.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    least = named.groupBy("top").agg(F.min("id").alias("least"))
    named = named.join(least, "top").select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))

    real = lambda c: F.when(c != NO_ID, c)
    out = keyed.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "least")
    out = out.unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least")))
    return out.select(real(F.col("id")).alias("vec_id"), "n_links", real(F.col("least")).alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
