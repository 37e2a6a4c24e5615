"""Text trees, chunk files, catalog tables and event logs: readers and writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_LOG = "ts bigint, query_hash string, raw string, expanded string, result_count int, compile_hash string, caller string, session_id string, model string"
GENERATE_LOG = (
    "ts bigint, chunk_set_hash string, chunks array<string>, token_count bigint, content_hash string, compile_hash string, doc_file string, "
    "cache_hit boolean, caller string, session_id string, model string"
)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and content of the markdown files under root, without folders whose name begins with a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*(?=/)", "")
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    relative = F.substring(plain, F.length(base) + 2, F.lit(1 << 30))
    rows = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))


def discover(local: DataFrame, packages: DataFrame, active: DataFrame) -> DataFrame:
    """local and packages: path, content. Local files and those of active packages (active: name, the second folder of a path)."""
    name = F.element_at(F.split("path", "/"), 2)
    wanted = packages.withColumn("name", name).join(active.select("name"), "name", "left_semi").drop("name")
    return local.unionByName(wanted.select(*local.columns))


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """A catalog, index or chunk table as Parquet, in folders by a column if it is named."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df has are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chunk_content(chunks: DataFrame, id_: str) -> DataFrame:
    """One chunk; the prefix of its id tells its type, so only that partition is read."""
    kind = {"spec": "spec", "sys": "system"}.get(id_.split(":", 1)[0], "object")
    return chunks.where((F.col("type") == kind) & (F.col("id") == id_)).select("id", "content")


def id_folder(id_: Column, digits: int = 2) -> Column:
    """The folder of an id: the first hexadecimal digits of its hash."""
    return F.concat(F.lit("b"), F.substring(F.sha2(id_.cast("binary"), 256), 1, digits))


def write_by_id(chunks: DataFrame, path: str, digits: int = 2) -> None:
    """chunks (id and others) as Parquet for ``read_by_id``: 16 ** digits folders by a hash of the id, files sorted by id, with bloom filters.

    Equal texts share an id; adaptive execution splits a folder that many rows fall into, so it may have several files. Null ids go.
    """
    rows = chunks.where("id is not null").withColumn("folder", id_folder(F.col("id"), digits)).hint("rebalance", F.col("folder"))
    rows = rows.sortWithinPartitions("folder", "id")
    rows.write.option("parquet.bloom.filter.enabled#id", "true").mode("overwrite").partitionBy("folder").parquet(path)


def read_by_id(spark: SparkSession, path: str, ids: list[str], digits: int = 2) -> DataFrame:
    """The chunks with these ids (some thousands at most): only their folders are listed to the scan. Ids that don't exist give nothing."""
    wanted = sorted(set(ids))
    folders = sorted({"b" + hashlib.sha256(i.encode()).hexdigest()[:digits] for i in wanted})
    return spark.read.parquet(path).where(F.col("folder").isin(folders) & F.col("id").isin(wanted)).drop("folder")


def strip_comment(content: Column) -> Column:
    """What follows the first comment's end."""
    at = F.locate("-->", content)
    return F.when(at > 0, F.regexp_replace(F.substring(content, at + 3, F.lit(1 << 30)), r"^\n+", "")).otherwise(content)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = QUERY_LOG, n: int | None = None) -> DataFrame:
    """Log entries; lines that aren't JSON are left out. n: the newest n."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.col("ts").desc()).limit(n) if n is not None else rows


def show_document(documents: DataFrame, prefix: str) -> DataFrame:
    """documents: hash, ts, content. The newest whose hash begins so."""
    return documents.where(F.col("hash").startswith(prefix)).agg(F.max_by("content", "ts").alias("content")).where("content is not null")


def render_session(entries: DataFrame, budget: int) -> DataFrame:
    """entries: place, title, content, tokens. The text of a session's context, with its tokens and share of the budget."""
    own = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("## "), "title", F.lit("\n\n"), "content").alias("text"))))
    total = F.sum("tokens")
    head = F.concat(F.lit("# Context\n\n"), total.cast("string"), F.lit(f" of {budget} tokens\n\n"))
    return entries.agg(F.concat(head, F.array_join(F.transform(own, lambda x: x["text"]), "\n\n")).alias("text"), total.alias("tokens"), F.round(100 * total / budget, 1).alias("used"))


PLAN = (
    "name string, status string, current_step int, dependencies array<struct<path:string,hash:string>>, "
    "steps array<struct<id:int,title:string,status:string,queries:array<string>,chunks:array<string>,blocked_by:array<int>>>"
)


def load_plans(spark: SparkSession, pattern: str) -> DataFrame:
    """Plans from JSON files, one plan each."""
    return spark.read.schema(PLAN).option("multiLine", True).json(pattern)


def find_plan(plans: DataFrame, name: str | None = None) -> DataFrame:
    """The plan of that name; without a name, the only one. A LookupError if there is none, or if several could be meant."""
    hits = plans if name is None else plans.where(F.col("name") == name)
    found = [r["name"] for r in hits.select("name").limit(2).collect()]
    if not found:
        raise LookupError("no plans" if name is None else f"no plan is named {name}")
    if name is None and len(found) > 1:
        raise LookupError(f"several plans, among them {' and '.join(map(str, found))}: name one")
    return hits


def search_packages(registry: DataFrame, text: str, prefix: str, n: int) -> DataFrame:
    """registry: name, author, stars, latest. Packages whose name has the prefix and, beyond it, the text; by stars."""
    hits = registry.where(F.col("name").startswith(prefix) & F.substring("name", len(prefix) + 1, 1 << 30).contains(text) & (F.length("name") > len(prefix)))
    return hits.orderBy(F.col("stars").desc(), "name").limit(n)
