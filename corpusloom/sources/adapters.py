"""The corpus tables seen as a documentation tree: sources, blocks, chunks and their SQL twins.

A document is a source; its path follows from its language, source and id. Each of its lines is a block; of every
fourth one the first two words are a heading, and the rest is a block of its own. A chunk of these adapters is a heading with what follows up
to the next; the real chunker is another operator, and the search queries run on its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and doc_id of each document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(
        F.when(F.col("doc_id") % 7 == 0, "system/").otherwise(""), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 5 == 0, ".spec.md").otherwise(".md"),
    )
    return docs.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def blocks(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """path, position, type, level, content and tokens of each line that isn't blank; line n is at 2 n, what follows its heading at 2 n + 1.

    dealt: whole texts are shuffled by path before they are cut, for those who need a path's blocks with their texts in one task.
    """
    files = sources(spark, sf_dir).select("path", "text")
    lines = (files.repartition("path") if dealt else files).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    n, two = F.col("n").cast("bigint"), r"^(\S+(?: \S+)?)"
    heading = n % 4 == 0
    block = lambda at, kind, level, content: F.struct(at.alias("position"), kind.alias("type"), level.cast("bigint").alias("level"), content.alias("content"))
    own = F.when(heading, block(2 * n, F.lit("heading"), 1 + F.floor(n / 4) % 3, F.regexp_extract("line", two, 1))).otherwise(
        block(2 * n, F.lit("paragraph"), F.lit(0), F.trim("line"))
    )
    rest = F.when(heading, block(2 * n + 1, F.lit("paragraph"), F.lit(0), F.trim(F.regexp_replace("line", two, ""))))
    rows = lines.where(F.trim("line") != "").select("path", F.explode(F.array(own, rest)).alias("b")).select("path", "b.*")
    rows = rows.where((F.col("position") % 2 == 0) | (F.col("content") != ""))
    return rows.withColumn("tokens", text.estimated_tokens(F.col("content")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, source, heading, sequence, total, tokens and content; four lines each."""
    b = blocks(spark, sf_dir).withColumn("sequence", (F.floor(F.col("position") / 8) + 1).cast("bigint"))
    own = F.array_sort(F.collect_list(F.struct("position", "content")))
    c = b.groupBy("path", "sequence").agg(own.alias("own"), F.sum("tokens").alias("tokens"))
    kind = paths.classify_source(F.col("path"))
    c = c.select(
        F.col("path").alias("source"), "sequence", "tokens", kind.alias("type"), F.array_join("own.content", "\n").alias("content"),
        F.regexp_replace(F.col("own")[0]["content"], " ", " > ").alias("heading"),
    )
    digest = F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16)
    return c.withColumn("id", paths.format_id(F.col("type"), digest, F.col("sequence")))


SOURCES_SQL = """src AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'system/' ELSE '' END || lang || '/' || source || '/' || doc_id
         || CASE WHEN doc_id % 5 = 0 THEN '.spec.md' ELSE '.md' END AS path, coalesce(text, '') AS text
  FROM documents)"""

BLOCKS_SQL = SOURCES_SQL + """, lines AS (
  SELECT path, unnest(string_split(text, chr(10))) AS line,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS position FROM src),
blk0 AS (
  SELECT path, 2 * position AS position, CASE WHEN position % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS type,
         CASE WHEN position % 4 = 0 THEN 1 + (position // 4) % 3 ELSE 0 END::BIGINT AS level,
         CASE WHEN position % 4 = 0 THEN regexp_extract(line, '^(\\S+(?: \\S+)?)', 1) ELSE trim(line) END AS content
  FROM lines WHERE trim(line) <> ''
  UNION ALL SELECT path, 2 * position + 1, 'paragraph', 0, trim(regexp_replace(line, '^\\S+(?: \\S+)?', '')) FROM lines
  WHERE position % 4 = 0 AND trim(regexp_replace(line, '^\\S+(?: \\S+)?', '')) <> ''),
blk AS (SELECT *, ceil(strlen(content) / 4)::BIGINT AS tokens FROM blk0)"""

KIND_SQL = "CASE WHEN path LIKE '%.spec.md' THEN 'spec' WHEN path LIKE 'system/%' THEN 'system' ELSE 'object' END"

CHUNKS_SQL = BLOCKS_SQL + f""", chk0 AS (
  SELECT path, position // 8 + 1 AS sequence, sum(tokens)::BIGINT AS tokens, string_agg(content, chr(10) ORDER BY position) AS content,
         replace(arg_min(content, position), ' ', ' > ') AS heading
  FROM blk GROUP BY ALL),
chk AS (
  SELECT path AS source, sequence, tokens, {KIND_SQL} AS type, content, heading,
         CASE {KIND_SQL} WHEN 'spec' THEN 'spec:' WHEN 'system' THEN 'sys:' ELSE 'obj:' END
         || substr(sha256(content), 1, 16) || '.' || sequence AS id
  FROM chk0)"""
