"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and its rows are the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, overlap, packing, pii, quality_crf
from corpusloom.llm.common import crc_mod, materialize, table
from corpusloom.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents without one (no letters, or null) go."""
    model = language_id.fit_on(docs.where(crc_mod("doc_id", 5) != 0))
    return language_id.set_language(docs.select(*COLUMNS), model, before=packing.forget)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    field = quality_crf.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality_crf.keep_documents(docs.select(*COLUMNS), field)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 of their five-word shingles, the one with the least id stays."""
    return overlap.drop_near_copies(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redact_column(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("simhash", drop_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model, the line labels and the fingerprints' links can't be stated in SQL.
ORACLE_SQL = None
