"""A corpus pipeline of five training-data operators.

Each stage takes the documents that its predecessor kept; all but the last return the columns of
``documents``.  ``run`` writes each result as Parquet into the shared checkpoint folder and reads it
again, so a lost executor never costs more than the stage at hand.

Defined results: null ids and texts, repeated rows and further columns, whatever their names, pass through
the filters as documents of their own; rows with the same id and text count as one document in the Jaccard
stage, rows with the same id, text and source in the mixing stage (of rows that differ in other columns only,
the one with the least hash stays); texts without words pass all stages; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.jaccard_join import jaccard_components
from roomtrace.llm.mixing import WORD, mix_sources
from roomtrace.llm.packing import pack_documents
from roomtrace.llm.substring_dedup import deduplicate
from roomtrace.llm.toxicity import drop_toxic

def _col(name: str):
    return F.col(f"`{name}`")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of a document) and the keys that tell documents apart: null-safe id and source and a hash of the text."""
    return docs.select(_row_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("text_hash"), _row_id(F.col("source")).alias("source"),
                       F.struct(*[_col(c) for c in docs.columns]).alias("row"))


def _row_id(c):
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _one_of_each(keyed: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, whatever the layout of the input."""
    return keyed.groupBy(*keys).agg(F.min_by("row", F.xxhash64("row")).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness of at least 0.8): the
    one with the smallest id.  Documents without words are in no group."""
    found = jaccard_components(docs, k=5, pct=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x")
    chosen = found.where("class_id is not null").groupBy("root").agg(first).select(_row_id(F.col("x.doc_id")).alias("id"), "x.text_hash")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = _one_of_each(_keyed(docs.where(worded)).join(chosen, ["id", "text_hash"], "left_semi"), "id", "text_hash").select("row.*")
    return kept.unionByName(docs.where(~worded))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat from documents with smaller ids; what has nothing left goes."""
    others = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    out = deduplicate(docs.select("doc_id", "text", *[_col(c).alias(x) for c, x in others.items()]), n=13, keep=tuple(others.values()), as_written=True)
    out = out.where("n_removed = 0 or n_removed < n_words")
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(F.col(others[c]) if c in others else own[c]).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those without words once."""
    copies = mix_sources(docs).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    copies = copies.select(_row_id(F.col("doc_id")).alias("id"), "text_hash", _row_id(F.col("source")).alias("source"), "copies")
    keys = ["id", "text_hash", "source"]
    taken = _one_of_each(_keyed(docs), *keys).join(copies, keys)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # classifier, pivotal rounding and tokenizer are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    from roomtrace.session import checkpoint_dir

    store = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{store}/{name}")
        docs = spark.read.parquet(f"{store}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
