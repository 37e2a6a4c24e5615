"""Small operators that the other modules use, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, fuse, incremental, index, taxonomy
from ..registry import query
from ..sources.adapters import BLOCKS_SQL, CHUNKS_SQL, blocks, chunks, table
from . import score_queries as S
from .taxonomy_queries import EXP_SQL, FULL_SQL, RANK_SQL, STRUCTURAL_SQL, full_terms, marked
from .text_queries import KEY_SQL


@query("J1_lookup", f"WITH {CHUNKS_SQL} SELECT c.id, c.source, c.sequence, c.tokens FROM chk c WHERE c.id IN (SELECT min(id) FROM chk GROUP BY type)")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by id: here the least id of each type."""
    c = chunks(spark, sf_dir)
    wanted = c.groupBy("type").agg(F.min("id").alias("id")).select("id")
    return catalog.lookup(c, wanted).select("id", "source", "sequence", "tokens")


@query("J17_expansion_lookup", f"WITH {EXP_SQL} SELECT query, count(*)::BIGINT AS words, count(key)::BIGINT AS known FROM fo GROUP BY query")
def expansion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.taxonomy import alias_index

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    words = b.where(F.size(text.tokens(F.col("text"))) > 0).select("query", F.explode(text.raw_words(F.col("text"))).alias("alias"))
    found = words.join(alias_index(full_terms(spark, sf_dir)), "alias", "left")
    return found.groupBy("query").agg(F.count("*").alias("words"), F.count("key").alias("known"))


@query("J18_rerank_window", f"WITH {S.RRF_SQL}{S.MANIFEST_SQL} SELECT query, count(*)::BIGINT AS hits, count(DISTINCT source)::BIGINT AS sources FROM fu JOIN mf USING (doc) WHERE rank <= ceil(10 * 2.15) GROUP BY query")
def rerank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = S.manifest(spark, sf_dir)
    near = S.fused(spark, sf_dir).where("rank <= ceil(10 * 2.15)").join(m, "doc")
    return near.groupBy("query").agg(F.count("*").alias("hits"), F.countDistinct("source").alias("sources"))


@query("L1_top_n", f"WITH {S.BM25_SQL} SELECT query, doc, score FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS n FROM hit) WHERE n <= 3")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top(S.hits(spark, sf_dir, 3), 3, ("query",)).select("query", "doc", "score")


@query("L2_rrf_order", f"WITH {S.RRF_SQL} SELECT query, doc, rank FROM fu WHERE rank <= 10")
def rrf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fused(spark, sf_dir).where("rank <= 10").select("query", "doc", "rank")


@query("L3_rerank_order", f"WITH {S.RERANK_SQL} SELECT query, doc, rank FROM re WHERE rank <= 10")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reranked(spark, sf_dir).where("rank <= 10").select("query", "doc", "rank")


@query("L5_type_order", f"WITH {CHUNKS_SQL} SELECT source, sequence, row_number() OVER (PARTITION BY split_part(source, '/', -2) ORDER BY CASE type WHEN 'system' THEN 1 WHEN 'spec' THEN 2 ELSE 0 END, source, sequence) AS place FROM chk")
def type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.by_type(chunks(spark, sf_dir), F.element_at(F.split("source", "/"), -2))


@query("L9_result_count", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 1 THEN 12 END, 30)::BIGINT AS n FROM part")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag before the configured number, before 30."""
    k = F.col("p_partkey") % 3
    n = fuse.result_count(F.when(k == 0, F.col("p_size")), F.when(k == 1, F.lit(12)))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"))


@query("U2_union_chunks", f"WITH {CHUNKS_SQL} SELECT source, sequence, tokens + CASE WHEN strlen(source) % 2 = 1 THEN 1 ELSE 0 END AS tokens, strlen(source) % 2 = 1 AS fresh FROM chk")
def union_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks stand for the last build; those of sources with paths of odd length are built anew, with a token more."""
    kept = chunks(spark, sf_dir).select("source", "sequence", "tokens")
    fresh = kept.where(F.octet_length("source") % 2 == 1).withColumn("tokens", F.col("tokens") + 1)
    return incremental.union_chunks(fresh, kept)


@query("U5_append_unique", f"WITH {FULL_SQL} SELECT key, list_distinct(list_concat(aliases, [left(key, 3), 'more'])).list_sort() AS aliases FROM full_")
def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.array(F.substring("key", 1, 3), F.lit("more"))
    return full_terms(spark, sf_dir).select("key", F.array_sort(F.array_distinct(F.concat("aliases", more))).alias("aliases"))


@query("X1_structural", f"WITH {STRUCTURAL_SQL} SELECT chunk, block, canonical, source FROM st")
def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.structural(marked(spark, sf_dir)).select("chunk", "block", "canonical", "source")


@query(
    "X11_extract",
    f"""WITH {STRUCTURAL_SQL}, keyed AS (SELECT *, {KEY_SQL.format('canonical')} AS key FROM st),
        best AS (SELECT key, arg_min((canonical, source), ({RANK_SQL}, chunk, block, kind, place)) AS b, count(DISTINCT chunk)::BIGINT AS uses FROM keyed WHERE key <> '' GROUP BY key)
        SELECT key, struct_extract(b, 1) AS canonical, struct_extract(b, 2) AS source, uses FROM best WHERE uses >= 2""",
)
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.extract(marked(spark, sf_dir)).select("key", "canonical", "source", F.size("chunks").cast("bigint").alias("uses"))


@query("A16_hash_table", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("R9_run_query", f"WITH {S.BM25_SQL}{S.MANIFEST_SQL} SELECT query, corpus, rank, doc, score, tokens FROM rk JOIN mf USING (doc) WHERE rank <= 5")
def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form of a search: three lists, one of each corpus, with what the manifest says."""
    m, _ = S.manifest(spark, sf_dir)
    return S.hits(spark, sf_dir, 5).join(m, "doc").select("query", "corpus", "rank", "doc", "score", "tokens")


@query("T19_definition_position", f"WITH {BLOCKS_SQL} SELECT path, position, regexp_matches(content, '(?m)^[ \\t]*(?:(?:[-*+]|\\d+[.)])[ \\t]*)?[A-Z]') AS defined FROM blk")
def definition_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("path", "position", taxonomy.definition_position(F.col("content")).alias("defined"))
