"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets of bounded size.  Each query first meets a bounded number
of the longest vectors, which gives a lower bound of its k-th best product.  A bucket whose longest
vector cannot reach that bound is skipped.  In the others the bound becomes a cosine threshold local to
query and bucket: where it is high, candidates are pruned by the range that the query's largest
coordinates allow (coordinate pruning), else by their own length (length pruning); what is left is
verified by its product.  Queries meet buckets block by block; the best k of each block are merged.

Defined results: a vector that is null or has null, NaN or infinite components takes no part; vectors
of different dimension never meet; a row repeated with the same id and components counts once; an id
with several vectors is several candidates, and as a query ranks all its results together; a query's
own id is never its candidate; ties go to the smaller id; null ids take no part; an empty table gives
an empty result; further columns are ignored.  Components must be integers small enough for exact
products in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import begin, map_arrow, mix, tidy

SEEDS = 2048  # longest vectors that every query meets first
BUCKET, BLOCK = 4096, 2048  # vectors in a bucket, queries in a block
COSINE = 0.6  # local threshold from which coordinates prune
FOCUS = 4  # coordinates used
BINS = 8  # length bins a factor of two


def _matrix(col) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(q_ids, q, floor, ids, v, k: int) -> tuple[list, list, list]:
    """Best candidates of one bucket for a block of queries; ``floor``: least product that can matter."""
    norm = np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    ids, v, norm = ids[order], v[order], norm[order]
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    q_norm = np.sqrt((q * q).sum(axis=1))
    reach = q_norm * (norm[0] if len(norm) else 0)
    local = np.where(reach > 0, floor / np.where(reach > 0, reach, 1), np.where(floor > 0, np.inf, -np.inf))
    out: tuple[list, list, list] = ([], [], [])

    def keep(i: int, at: np.ndarray, products: np.ndarray) -> None:
        fit = (products >= floor[i]) & (ids[at] != q_ids[i])
        at, products = at[fit], products[fit]
        top = best(products, ids[at], k)
        for col, x in zip(out, (np.full(len(top), q_ids[i]), ids[at][top], products[top])):
            col.append(x)

    for i in np.flatnonzero((local >= COSINE) & (local <= 1 + 1e-9)):
        c = q[i] / q_norm[i]
        t = min(local[i], 1.0) - 1e-9
        at = np.arange(len(ids))
        for f in np.argsort(-np.abs(c))[:FOCUS]:
            slack = np.sqrt(max(0.0, (1 - t * t) * (1 - c[f] * c[f]))) + 1e-9
            low = -1.0 if -c[f] >= t else c[f] * t - slack
            high = 1.0 if c[f] >= t else c[f] * t + slack
            x = unit[at, f]
            at = at[(x >= low - 1e-9) & (x <= high + 1e-9)]
        keep(i, at, v[at] @ q[i])
    rest = np.flatnonzero(local < COSINE)
    for lo in range(0, len(rest), 256):
        part = rest[lo:lo + 256]
        need = np.where(q_norm[part] > 0, floor[part] / np.where(q_norm[part] > 0, q_norm[part], 1), -np.inf) - 1e-9
        long_enough = np.searchsorted(-norm, -need, side="right")  # vectors are in falling length
        products = q[part] @ v[:long_enough.max()].T
        for row, (i, n) in enumerate(zip(part, long_enough)):
            keep(i, np.arange(n), products[row, :n])
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).dropDuplicates(["vec_id", "v"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select("*", F.size("v").alias("dim"), norm.alias("norm"))
    bin_ = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * BINS)).otherwise(-10_000).cast("int")
    rows = rows.withColumn("bin", bin_)
    # a row for each dimension and length bin: a bounded table
    stats = [(r["dim"], r["bin"], r["n"], r["most"]) for r in rows.groupBy("dim", "bin").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()]
    n_queries = rows.where("is_query").count()
    seeds = rows.orderBy(F.col("norm").desc(), "vec_id").select("vec_id", "v", "dim").limit(SEEDS).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {
        d: (np.array([s["vec_id"] for s in seeds if s["dim"] == d]), np.array([s["v"] for s in seeds if s["dim"] == d]))
        for d in {s["dim"] for s in seeds}}
    held = spark.sparkContext.broadcast((by_dim, stats))
    blocks = max(1, -(-n_queries // BLOCK))
    cuts = {(d, b): max(1, -(-n // BUCKET)) for d, b, n, _ in stats}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bucket that its bound allows."""
        seeds_of, table = held.value
        for b in batches:
            q_ids, dims = b.column("vec_id").to_numpy(), b.column("dim").to_numpy()
            block_of = mix(q_ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)
            out: list[tuple] = []
            for i, (qi, d, vec) in enumerate(zip(q_ids, dims, b.column("v").to_pylist())):
                q = np.array(vec)
                ids, v = seeds_of.get(d, (np.zeros(0), np.zeros((0, d))))
                products = v[ids != qi] @ q if len(ids) else np.zeros(0)
                floor = np.partition(products, len(products) - k)[len(products) - k] if len(products) >= k else -np.inf
                length = float(np.sqrt((q * q).sum()))
                for dim, bin_no, n, most in table:
                    if dim == d and length * most * (1 + 1e-12) >= floor:
                        out += [(dim, bin_no, s, int(block_of[i]), int(qi), float(floor), vec) for s in range(cuts[dim, bin_no])]
                if len(out) > 2000 or i == len(q_ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        list(zip(*out)) or [[]] * 7, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())))],
                        names=["dim", "bin", "sub", "block", "vec_id", "floor", "v"])
                    out = []

    asked = map_arrow(rows.where("is_query").select("dim", "vec_id", "v"), 
        meet, "dim int, bin int, sub int, block int, vec_id long, floor double, v array<double>")
    sub_of = F.create_map(*[x for (d, b), n in cuts.items() for x in (F.struct(F.lit(d).alias("dim"), F.lit(b).alias("bin")), F.lit(n))]) if cuts else None
    there = rows.select("dim", "bin", "vec_id", "v")
    count = sub_of[F.struct("dim", "bin")] if cuts else F.lit(1)
    there = there.withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), count).cast("int"))
    # candidates go only to the blocks that ask for their bucket
    there = there.join(asked.select("dim", "bin", "sub", "block").distinct().toDF("dim", "bin", "sub", "block"), ["dim", "bin", "sub"])

    def verify(key, left: pa.Table, right: pa.Table) -> pa.Table:
        begin(__name__)
        cols: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            cols = search_bucket(right.column("vec_id").to_numpy(), _matrix(right.column("v")), right.column("floor").to_numpy(),
                                 left.column("vec_id").to_numpy(), _matrix(left.column("v")), k)
        q, i, s = (np.concatenate(c) if c else np.zeros(0) for c in cols)
        if left.num_rows > 1000:
            tidy()
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(i.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    keys = ["dim", "bin", "sub", "block"]
    found = there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(verify, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
