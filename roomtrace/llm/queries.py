"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import documents
from roomtrace.llm.conversation_repair import digests, repair_conversations
from roomtrace.llm.embedding_dedup import near_duplicates
from roomtrace.llm.fingerprints import fingerprint_documents
from roomtrace.llm.jaccard_join import jaccard_components
from roomtrace.llm.lm_scores import lm_scores
from roomtrace.llm.mixing import mix_sources
from roomtrace.llm.packing import pack_documents
from roomtrace.llm.quality import quality_scores
from roomtrace.llm.spelling import count_words, spelling_groups
from roomtrace.llm.substring_dedup import deduplicate
from roomtrace.llm.token_counts import token_counts
from roomtrace.llm.toxicity import toxicity_scores
from roomtrace.llm.vector_search import exact_top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir), n=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), max_len=4096, end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), pattern=(1.0, 2.0, 3.0)).drop("text_hash", "source")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * 256).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("embedding"))
    out = exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=3, pct=90).select("doc_id", "n_shingles", "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), limit=1024)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target corpus: the texts of ``benchmark``; background: all documents."""
    return lm_scores(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that a checksum of conversation and turn deals; nulls count as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.crc32(key) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(rows))
    found = repair.report.join(digests(repair.rows).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    found = found.withColumnRenamed("conv_id", "_c")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(count_words(documents(spark, sf_dir), noise=True, min_length=5, min_count=3), ratio=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_packing, op4_quality, op5_mixing, op6_vector_search, op7_jaccard_join,
                            op8_token_counts, op9_fingerprints, op10_lm_scores, op11_conversation_repair,
                            op12_embedding_dedup, op13_spelling_variants)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
with docs as (select doc_id, {_WORDS} as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as words
            from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from docs where len(ws) >= 13)),
seen as (select doc_id, i, min(doc_id) over (partition by words) as least from windows),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from seen where doc_id > least),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from docs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n
         from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (doc_id)""",
    "op6_vector_search": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""",
    "op7_jaccard_join": rf"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s
             from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from docs where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from docs union select r.a, e.b from reach r join ways e on e.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, min(r.b) as component_id
from docs d left join sizes s on s.doc_id = d.doc_id join reach r on r.a = d.doc_id group by d.doc_id, n""",
    "op12_embedding_dedup": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
                     where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                       and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
degrees as (select a, count(*) as n from links group by a),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on least.a = vec_id left join degrees on degrees.a = vec_id""",
}
