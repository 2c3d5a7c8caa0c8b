"""Mixing sources to target weights by pivotal rounding over a distributed reduction tree.

A document of source ``s`` is wanted ``target(s) / size(s)`` times.  The whole part is taken outright;
the fractional parts are rounded by the pivotal method, with mass counted in words: two documents with
fractions meet, and one gives mass to the other, at random in the proportion that keeps both
expectations, until one of them has become 0 or 1.  The words of a source thereby stay constant up to
the last fraction left.  Each chunk of a source (a bounded number of its rows, chosen by hash) is
rounded in its own task and leaves at most one residual; residuals of neighbouring chunks meet on the
next level of a tree, until one a source remains, which a coin decides.

Random choices are hashes of the document (id, text, and a number that tells equal rows apart) and a seed,
and documents meet in an order given by the same, so reruns agree whatever the layout of the input.

Defined results: a null text has size 0 and nothing is taken of it, as of every document without
words; null ``source`` is a source of its own, after all others; null ``doc_id`` and repeated rows are
documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import shared_checkpoint, ship

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 8192  # rows rounded together in one task
FAN_IN = 512  # residuals that meet in one task of the tree
MAX_COPIES = 3
RUN = 8192  # equal rows numbered at once
SMALL_SOURCES = 200_000  # sources whose table may be broadcast


def word_count(text) -> F.Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, pattern: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MAX_COPIES) -> tuple[DataFrame, int]:
    """Per source: ``source, source_size, rows, target, rate``; and the number of sources.

    Sources in code point order, null last, have the weights of ``pattern`` in turn.  They share all
    words by weight; a source above ``most`` times its size is held there and the excess is shared
    again by the others, until none is above.  The rounds run as aggregates over the table of sources.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = per.orderBy(F.col("source").asc_nulls_last())
    ranked = per.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], x[1]))
    per = spark.createDataFrame(ranked, "source string, source_size long, rows long, place long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (F.col("place") % len(pattern) + 1).cast("int"))
    per = shared_checkpoint(per.withColumn("weight", weight))
    total, n = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    limit = F.col("source_size") * float(most)
    held, share = F.lit(False), F.lit(0.0)  # a source stays held as the level of the others only rises
    while True:
        free, taken = per.agg(F.sum(F.when(~held, F.col("weight"))), F.sum(F.when(held, limit))).first()
        if not free:
            break
        share = F.col("weight") * ((total - (taken or 0.0)) / free)
        if not per.where(~held & (share > limit)).limit(1).count():
            break
        held = held | (share > limit)
    target = F.when(held, limit).otherwise(share)
    rate = F.when(held, F.lit(float(most))).when(F.col("source_size") > 0, share / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "rows", target.alias("target"), rate.alias("rate")), n


def pivot(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions in the given order: 0 or 1 each, but for one residual (its place, or -1)."""
    p = p.astype(np.float64).copy()
    a = -1
    for b in np.flatnonzero((p > 0) & (p < 1)):
        if a < 0:
            a = b
            continue
        sa, sb = size[a], size[b]
        up, down = min((1 - p[a]) * sa, p[b] * sb), min(p[a] * sa, (1 - p[b]) * sb)
        if coin[b] * (up + down) < down:  # a gains from b
            if (1 - p[a]) * sa <= p[b] * sb:
                p[b] = min(max(p[b] - up / sb, 0.0), 1.0)
                p[a] = 1.0
            else:
                p[a] = min(p[a] + up / sa, 1.0)
                p[b] = 0.0
        else:
            if p[a] * sa <= (1 - p[b]) * sb:
                p[b] = min(max(p[b] + down / sb, 0.0), 1.0)
                p[a] = 0.0
            else:
                p[a] = max(p[a] - down / sa, 0.0)
                p[b] = 1.0
        open_a, open_b = 0 < p[a] < 1, 0 < p[b] < 1
        a = a if open_a else b if open_b else -1
    return p, int(a)


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Round one group, largest documents first; ``part`` stays a fraction for the residual alone."""
    pdf = pdf.sort_values(["size", "coin", "doc_id", "text_hash", "copy"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
    pdf["part"], _ = pivot(pdf["part"].to_numpy(), pdf["size"].to_numpy(), pdf["coin"].to_numpy())
    return pdf


def mix_sources(docs: DataFrame, pattern: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, copies, text_hash, source`` (``taken = copies * size``;
    a document without words is taken once).

    Only ids, sources and sizes are shuffled, not texts.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    ship(docs.sparkSession)
    targets, n_sources = source_targets(sizes, pattern)
    if n_sources <= SMALL_SOURCES:
        targets = F.broadcast(targets)
    rows = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # equal rows are counted and numbered
    rows = rows.groupBy("doc_id", "source", "size", "text_hash", "source_size", "rows", "target", "rate").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, "_n") - 1)))

    def coin(level: int):
        return (F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "text_hash", "copy"), F.lit(1 << 40)) / float(1 << 40)).alias("coin")

    chunks = F.ceil(F.col("rows") / CHUNK)
    rows = rows.select("doc_id", "source", "size", "text_hash", "copy", "source_size", "target",
                       F.when(F.col("size") > 0, F.floor("rate")).otherwise(1).cast("int").alias("whole"),
                       F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("part"),
                       coin(1),
                       F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash", "copy"), chunks).cast("long").alias("chunk"))
    schema = rows.schema
    done = shared_checkpoint(rows.groupBy("source", "chunk").applyInPandas(_round, schema))
    parts, level = [], 1
    while True:
        loose = (F.col("part") > 0) & (F.col("part") < 1)
        parts.append(done.where(~loose))
        rest = done.where(loose)
        top = rest.agg(F.max("chunk")).first()[0]
        if not top:
            parts.append(rest.withColumn("part", (F.col("coin") < F.col("part")).cast("double")))
            break
        level += 1
        rest = rest.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long")).withColumn("coin", coin(level))
        done = shared_checkpoint(rest.groupBy("source", "chunk").applyInPandas(_round, schema))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.col("part").cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
                      copies.alias("copies"), "text_hash", "source")
