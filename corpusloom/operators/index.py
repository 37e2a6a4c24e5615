"""Inverted index tables and their scores, for any number of corpora and queries at once.

Documents are keyed by ``doc`` within ``corpus``. Sums are rounded to nine decimals, as they depend on the order of addition; ties
go to the lesser key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, FieldWeight
from ..functions.text import term_counts

DIGITS = 9


def postings(docs: DataFrame) -> DataFrame:
    """docs: corpus, doc, tokens (array), each document once. One row per term of a document, with tf; terms are counted within the row, so nothing is shuffled."""
    return docs.select("corpus", "doc", F.inline(term_counts("tokens")))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("corpus", "doc", F.size("tokens").cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """n and avgdl; empty documents count."""
    return lengths.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(post: DataFrame, corpora: DataFrame) -> DataFrame:
    df = post.groupBy("corpus", "term").agg(F.count("*").alias("df"))
    return df.join(corpora, "corpus").select("corpus", "term", "df", F.round(idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))


def index_stats(post: DataFrame, lengths: DataFrame) -> DataFrame:
    """Distinct terms, documents and mean length of each corpus."""
    terms = post.groupBy("corpus").agg(F.countDistinct("term").alias("terms"))
    docs = corpus_stats(lengths)
    return docs.join(terms, "corpus", "left").select("corpus", F.coalesce("terms", F.lit(0)).cast("bigint").alias("terms"), F.col("n").alias("docs"), F.round("avgdl", 6).alias("avgdl"))


def bm25(query_terms: DataFrame, post: DataFrame, lengths: DataFrame, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b) -> DataFrame:
    """query_terms: query, term (repeats count). query, corpus, doc and score of documents that score above 0."""
    wanted = query_terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    corpora = corpus_stats(lengths)
    # only terms that some query has; their documents are counted before they meet the queries
    hits = post.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("corpus", "term").agg(F.count("*").alias("df"))
    stats = df.join(corpora, "corpus").select("corpus", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    tf = F.col("tf")
    norm = tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    weighted = hits.join(stats, ["corpus", "term"]).join(lengths, ["corpus", "doc"]).select("corpus", "doc", "term", (F.col("idf") * tf * (k1 + 1) / norm).alias("w"))
    scored = weighted.join(wanted, "term").groupBy("query", "corpus", "doc").agg(F.round(F.sum(F.col("w") * F.col("times")), DIGITS).alias("score"))
    return scored.where("score > 0")


def top(scored: DataFrame, n: int, by: tuple[str, ...] = ("query", "corpus")) -> DataFrame:
    """The n best of each group by (score desc, doc); n <= 0: all. Adds ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= n) if n > 0 else ranked


def field_postings(docs: DataFrame) -> DataFrame:
    """docs: corpus, doc, field, tokens, each field once. tf of each term in each field."""
    return docs.select("corpus", "doc", "field", F.inline(term_counts("tokens")))


def field_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("corpus", "doc", "field", F.size("tokens").cast("bigint").alias("dl"))


def field_averages(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("corpus", "field").agg(F.avg("dl").alias("avgdl"))


def field_document_frequency(post: DataFrame) -> DataFrame:
    """A document counts once, in however many fields it has the term."""
    return post.groupBy("corpus", "term").agg(F.countDistinct("doc").alias("df"))


def bm25f(query_terms: DataFrame, post: DataFrame, lengths: DataFrame, fields: dict[str, FieldWeight] | None = None, k1: float = DEFAULTS.k1) -> DataFrame:
    """query_terms: query, term, weight. query, corpus, doc and score of documents that score above 0."""
    fields = fields or DEFAULTS.fields
    hits = post.join(query_terms.select("term").distinct(), "term", "left_semi")
    n = lengths.groupBy("corpus").agg(F.countDistinct("doc").alias("n"))
    df = field_document_frequency(hits).join(n, "corpus").select("corpus", "term", idf(F.col("n"), F.col("df")).alias("idf"))
    weight, slope = F.lit(0.0), F.lit(0.0)
    for name, f in fields.items():
        weight = F.when(F.col("field") == name, F.lit(f.weight)).otherwise(weight)
        slope = F.when(F.col("field") == name, F.lit(f.b)).otherwise(slope)
    tf = hits.join(lengths, ["corpus", "doc", "field"]).join(field_averages(lengths), ["corpus", "field"])
    part = F.when(F.col("avgdl") > 0, F.col("tf") / (1 - slope + slope * F.col("dl") / F.col("avgdl"))).otherwise(F.col("tf"))
    # the sum over fields is rounded, since it enters a ratio
    wtf = tf.select("corpus", "doc", "term", (weight * part).alias("w")).groupBy("corpus", "doc", "term").agg(F.round(F.sum("w"), 12).alias("wtf"))
    each = wtf.join(df, ["corpus", "term"]).join(query_terms.select("query", "term", "weight"), "term")
    s = F.col("weight") * F.col("idf") * F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1)
    return each.groupBy("query", "corpus", "doc").agg(F.round(F.sum(s), DIGITS).alias("score")).where("score > 0")
