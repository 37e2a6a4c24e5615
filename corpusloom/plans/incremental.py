"""A stored corpus that follows its files: an update works on new, modified and deleted files only.

A store is a folder of Parquet tables. ``files``, ``chunks``, ``postings`` and ``lengths`` lie in folders by a hash of the source (``part``), ``frequencies`` (corpus, term, df)
by a hash of the term, ``corpora`` (corpus, n, total length) in one. An update

1. compares the files' hashes with the stored ones;
2. parses, chunks and counts the new and modified files alone;
3. in the parts that changed files lie in, takes out what belongs to modified and deleted files, and puts in what is new;
4. adds signed differences to document frequencies and totals: minus one for each posting taken out, plus one for each put in;
5. stages the whole new content of all folders that change, notes that in a journal, moves it in with dynamic overwriting, and removes folders that have become empty.

Folders in which nothing changes aren't written. If an update is broken off before its journal is complete, the store is as before; if later, the next
call first moves the staged folders in again, which gives the same however far it had come.

Defined results: a null content counts as empty; a path that comes twice is an error, as chunks are known by their source; an empty table of files empties the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import paths, text
from ..operators import blocks as B
from ..operators import chunking, incremental, index, parse
from ..session import cut

#: Folders of each table.
PARTS = 64
#: The columns of the stored tables, but for their folder.
TABLES = {
    "files": "path string, hash string",
    "chunks": "source string, sequence bigint, type string, doc string, id string, heading string, tokens bigint, content string",
    "postings": "source string, corpus string, doc string, term string, tf bigint",
    "lengths": "source string, corpus string, doc string, dl bigint",
    "frequencies": "corpus string, term string, df bigint",
    "corpora": "corpus string, n bigint, total bigint",
}


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def load(spark: SparkSession, store: str, table: str) -> DataFrame:
    """A table of the store, empty if there is none yet."""
    schema = f"{TABLES[table]}, part int"
    files, where = _path(spark, f"{store}/{table}")
    return spark.read.schema(schema).parquet(f"{store}/{table}") if files.exists(where) else spark.createDataFrame([], schema)


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def corpus_rows(files: DataFrame, config: Config, count: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, postings and lengths of files (path, content)."""
    blocks = B.strip(parse.parse_blocks(files)).withColumn("tokens", count(F.col("content")))
    doc = F.concat("source", F.lit("#"), F.col("sequence").cast("string"))
    chunks = chunking.chunk(blocks, config.chunk).select(
        "source", F.col("sequence").cast("bigint").alias("sequence"), "type", doc.alias("doc"), "id", "heading", F.col("tokens").cast("bigint").alias("tokens"), "content"
    )
    chunks = cut(chunks)
    docs = chunks.select("source", paths.output_dir(F.col("type")).alias("corpus"), "doc", text.tokens(F.col("content")).alias("tokens"))
    sources = chunks.select("doc", "source")
    postings = index.postings(docs).join(sources, "doc").select("source", "corpus", "doc", "term", "tf")
    return chunks, postings, index.doc_lengths(docs).join(sources, "doc").select("source", "corpus", "doc", "dl")


def update(files: DataFrame, store: str, config: Config = DEFAULTS, count: Callable[[Column], Column] = text.estimated_tokens) -> dict[str, int]:
    """Makes the store follow files (path, content); the first call builds it. How many files are new, modified, deleted and unchanged."""
    spark = files.sparkSession
    recover(spark, store)
    files = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    current = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    twice = current.groupBy("path").count().where("count > 1").select("path").first()
    if twice:
        raise ValueError(f"{twice.path} comes twice")
    status = cut(incremental.classify(current, load(spark, store, "files")))
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    done = {k: counts.get(k, 0) for k in ("new", "modified", "deleted", "unchanged")}
    if done["new"] + done["modified"] + done["deleted"] == 0:
        return done

    gone = status.where("status in ('modified', 'deleted')").select("path")
    come = status.where("status in ('new', 'modified')").select("path")
    touched = sorted(r.part for r in status.where("status <> 'unchanged'").select(part_of(F.col("path")).alias("part")).distinct().collect())
    chunks, postings, lengths = corpus_rows(files.join(come, "path", "left_semi"), config, count)
    postings, lengths = cut(postings), cut(lengths)
    out_postings = load(spark, store, "postings").where(F.col("part").isin(touched)).join(gone.withColumnRenamed("path", "source"), "source", "left_semi")
    out_lengths = load(spark, store, "lengths").where(F.col("part").isin(touched)).join(gone.withColumnRenamed("path", "source"), "source", "left_semi")

    staged = f"{store}/staged-{uuid.uuid4().hex}"
    new = {"files": current.join(come, "path", "left_semi"), "chunks": chunks, "postings": postings, "lengths": lengths}
    changed: dict[str, list[int]] = {}
    for name, rows in new.items():
        key = "path" if name == "files" else "source"
        stay = load(spark, store, name).where(F.col("part").isin(touched)).join(gone.withColumnRenamed("path", key), key, "left_anti")
        _stage(stay.unionByName(rows.withColumn("part", part_of(F.col(key)))), f"{staged}/{name}", name)
        changed[name] = touched

    signed = postings.select("corpus", "term", F.lit(1).alias("n")).unionByName(out_postings.select("corpus", "term", F.lit(-1).alias("n")))
    delta = signed.groupBy("corpus", "term").agg(F.sum("n").alias("df")).where("df <> 0").withColumn("part", part_of(F.col("term")))
    changed["frequencies"] = _add(spark, store, staged, "frequencies", delta, ("corpus", "term"), ("df",), "df > 0")
    signed = lengths.select("corpus", F.lit(1).alias("n"), F.col("dl").alias("total")).unionByName(out_lengths.select("corpus", F.lit(-1).alias("n"), (-F.col("dl")).alias("total")))
    delta = signed.groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("part", F.lit(0))
    changed["corpora"] = _add(spark, store, staged, "corpora", delta, ("corpus",), ("n", "total"), "n > 0")
    _note(spark, store, {"staged": staged.rsplit("/", 1)[1], "changed": changed})
    recover(spark, store)
    return done


def _stage(rows: DataFrame, path: str, table: str) -> None:
    rows.select(*[c.split()[0] for c in TABLES[table].split(", ")], "part").repartition("part").write.partitionBy("part").parquet(path)


def _add(spark: SparkSession, store: str, staged: str, table: str, delta: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...], keep: str) -> list[int]:
    """Stages the table's folders that delta touches, with delta added; which they are."""
    delta = cut(delta)
    touched = sorted(r.part for r in delta.select("part").distinct().collect())
    both = load(spark, store, table).where(F.col("part").isin(touched)).unionByName(delta.select(*keys, *sums, "part"))
    total = both.groupBy(*keys, "part").agg(*[F.sum(c).cast("bigint").alias(c) for c in sums]).where(keep)
    _stage(total, f"{staged}/{table}", table)
    return touched


def _note(spark: SparkSession, store: str, journal: dict) -> None:
    """The journal appears whole: it is written under another name first."""
    files, draft = _path(spark, f"{store}/draft")
    out = files.create(draft, True)
    out.write(json.dumps(journal).encode())
    out.close()
    files.rename(draft, _path(spark, f"{store}/journal")[1])


def _move_in(spark: SparkSession, store: str, staged: str, table: str, parts: list[int]) -> None:
    """The staged folders of a table replace the stored ones; those of parts without rows go."""
    rows = spark.read.schema(f"{TABLES[table]}, part int").parquet(f"{store}/{staged}/{table}")
    left = {r.part for r in rows.select("part").distinct().collect()}
    if left:
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{store}/{table}")
    for p in set(parts) - left:
        files, where = _path(spark, f"{store}/{table}/part={p}")
        files.delete(where, True)


def recover(spark: SparkSession, store: str) -> bool:
    """Finishes an update whose journal is complete; whether there was one."""
    files, where = _path(spark, f"{store}/journal")
    if not files.exists(where):
        return False
    lines = spark.read.text(f"{store}/journal", wholetext=True).first()
    journal = json.loads(lines[0])
    for table, parts in journal["changed"].items():
        _move_in(spark, store, journal["staged"], table, parts)
    files.delete(where, False)
    files.delete(_path(spark, f"{store}/{journal['staged']}")[1], True)
    return True
