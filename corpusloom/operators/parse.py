"""Files to blocks and links; stems of a vocabulary; noun phrases. Python where Spark has no expression, by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, words
from ..functions.markdown import parse as parse_markdown
from ..functions.stem import index_term
from ..session import bound_batches

ADJECTIVE = re.compile(r"(?:able|ible|al|ful|ic|ive|less|ous|ary|ant|ent)$")
NOUN = re.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ship|ism|ist|er|or|age|ure|ics|ware|base|ing)s?$")


def parse_blocks(files: DataFrame) -> DataFrame:
    """files: path, content. path, position, type, content, level and language of the top-level blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(parse_markdown(t).blocks)]
            yield pa.RecordBatch.from_pydict(
                {"path": [p for p, _, _ in rows], "position": [i for _, i, _ in rows], "type": [x.type for *_, x in rows], "content": [x.content for *_, x in rows],
                 "level": [x.level for *_, x in rows], "language": [x.language for *_, x in rows]},
                schema=pa.schema([("path", pa.string()), ("position", pa.int64()), ("type", pa.string()), ("content", pa.string()), ("level", pa.int64()), ("language", pa.string())]),
            )

    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, position bigint, type string, content string, level bigint, language string")


def parse_links(files: DataFrame) -> DataFrame:
    """path, ordinal, destination and text of links to other markdown files: the first of each destination, without its fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate(parse_markdown(t).links)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "ordinal", "destination", "text"]
            )

    bound_batches(files.sparkSession)
    raw = files.select("path", "content").mapInArrow(run, "path string, ordinal bigint, destination string, text string")
    kept = raw.where(~F.col("destination").rlike("^(https?://|#)")).withColumn("destination", F.substring_index("destination", "#", 1))
    kept = kept.where(F.lower("destination").endswith(".md"))
    first = kept.groupBy("path", "destination").agg(F.min(F.struct("ordinal", "text")).alias("m"))
    return first.select("path", "m.ordinal", "destination", "m.text")


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """terms: word (lower), original. Each distinct pair with its stem; code identifiers and technical words stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([index_term(w) for w in b.column(1).to_pylist()], pa.string())], names=["word", "original", "stem"])

    return terms.select("word", "original").distinct().mapInArrow(run, "word string, original string, stem string")


def stemmed_tokens(docs: DataFrame) -> DataFrame:
    """docs: doc, text. doc and its stemmed tokens in order, of documents that have any."""
    return docs.select("doc", text.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)


def _tag(word: Column, first: Column) -> Column:
    """A coarse tag by form: N (proper noun), n (noun), j (adjective), o. Approximate; a tagger can replace it."""
    lower = F.lower(word)
    capital = word.rlike("^[A-Z]") & ~first
    return (
        F.when(~word.rlike("^[A-Za-z]"), "o").when(lower.isin([*words.STOPWORDS, *words.RAKE_STOPWORDS]), "o").when(capital, "N")
        .when(lower.rlike(NOUN.pattern), "n").when(lower.rlike(ADJECTIVE.pattern), "j").otherwise("o")
    )


def noun_phrases(chunks: DataFrame) -> DataFrame:
    """chunks: chunk, content. Runs of adjectives and nouns with a noun in them: chunk, canonical, place. A single common noun isn't one."""
    from pyspark.sql import Window

    plain = text.strip_markdown(F.col("content"))
    # whole texts are dealt by chunk; their words stay where they are
    t = chunks.repartition("chunk").select("chunk", F.posexplode(F.regexp_extract_all(plain, F.lit(r"([A-Za-z][\w'-]*|[^\sA-Za-z]+)"), F.lit(1))).alias("at", "word"))
    order = Window.partitionBy("chunk").orderBy("at")
    before = F.lag("word").over(order)
    t = t.withColumn("tag", _tag(F.col("word"), before.isNull() | before.rlike(r"[.!?]$")))
    t = t.withColumn("run", F.sum((F.col("tag") == "o").cast("int")).over(order)).where("tag <> 'o'")
    p = t.groupBy("chunk", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("canonical"), F.count("*").alias("n"),
        F.bool_or(F.lower("tag") == "n").alias("noun"), F.bool_or(F.col("tag") == "N").alias("proper"), F.min("at").alias("place"),
        F.bool_or((F.lower("tag") == "n") & ~F.lower("word").isin(words.POS_STOPWORDS)).alias("telling"),
    )
    size = F.octet_length("canonical")
    p = p.where(F.col("noun") & F.col("telling") & (size >= 3) & (size <= 60) & ((F.col("n") > 1) | F.col("proper")))
    first = p.groupBy("chunk", F.lower("canonical").alias("key")).agg(F.min(F.struct("place", "canonical")).alias("m"))
    return first.select("chunk", "m.canonical", "m.place")


def named_entities(chunks: DataFrame) -> DataFrame:
    """Runs of capitalised words within sentences: chunk, canonical, place. Approximate; a model can replace it."""
    plain = text.strip_markdown(F.col("content"))
    found = F.regexp_extract_all(plain, F.lit(r"(?<![.!?] )(?<!^)\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1))
    rows = chunks.select("chunk", F.posexplode(found).alias("place", "canonical"))
    rows = rows.where((F.octet_length("canonical") >= 3) & (F.octet_length("canonical") <= 60) & ~F.lower("canonical").isin(words.POS_STOPWORDS))
    first = rows.groupBy("chunk", F.lower("canonical").alias("key")).agg(F.min(F.struct("place", "canonical")).alias("m"))
    return first.select("chunk", "m.canonical", "m.place")
