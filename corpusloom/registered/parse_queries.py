"""Parsing, stems and noun phrases; SQL only where DuckDB has a counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import parse
from ..registry import query
from ..sources.adapters import chunks, table
from .text_queries import RAW_SQL, stems_sql


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markdown: their heading, paragraphs, navigation links and comments."""
    h = F.col("html")
    title = F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1)
    paragraphs = F.array_join(F.transform(F.regexp_extract_all(h, F.lit(r"(?s)<p>(.*?)(?:</p>|<br>|(?=<p>))"), F.lit(1)), lambda p: F.regexp_replace(p, "<[^>]*>", "**")), "\n\n")
    hrefs = F.regexp_extract_all(h, F.lit(r'<a href="/([^"]*)">'), F.lit(1))
    items = F.array_join(F.transform(hrefs, lambda a: F.concat(F.lit("- ["), a, F.lit("]("), a, F.lit(".md#top)"))), "\n")
    comment = F.regexp_extract(h, r"(?s)(<!--.*?-->)", 1)
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), title), items, comment, paragraphs, F.lit("| Name | Kind |\n|---|---|\n| a | b |"), F.lit("```py\nx = 1\n```"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


@query("P1_parse_blocks")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_blocks(markdown_files(spark, sf_dir))


@query("P6_parse_links")
def parse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_links(markdown_files(spark, sf_dir))


@query("T5_stem", f"WITH k AS (SELECT unnest({RAW_SQL}) AS token FROM documents), {stems_sql('k')} SELECT lower(token) AS word, token AS original, term AS stem FROM stems")
def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("original"))
    return parse.stem_vocabulary(raw.select(F.lower("original").alias("word"), "original"))


@query("X8_noun_phrases")
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.noun_phrases(chunks(spark, sf_dir).select(F.concat("source", F.lit("#"), F.col("sequence").cast("string")).alias("chunk"), "content"))


@query("X9_named_entities")
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.named_entities(chunks(spark, sf_dir).select(F.concat("source", F.lit("#"), F.col("sequence").cast("string")).alias("chunk"), "content"))
