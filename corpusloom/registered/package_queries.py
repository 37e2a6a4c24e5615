"""Versions and dependency resolution, with parts standing for packages and their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import packages as P
from ..registry import query
from ..sources.adapters import table

TAGS_SQL = "tg AS (SELECT 'p' || p_partkey % 60 || '@a' AS ref, p_size || '.' || p_partkey % 9 || '.' || p_partkey % 4 || CASE WHEN p_partkey % 10 = 3 THEN '-rc.' || p_partkey % 12 ELSE '' END AS v, p_size AS a, p_partkey % 9 AS b, p_partkey % 4 AS c, CASE WHEN p_partkey % 10 = 3 THEN p_partkey % 12 ELSE 999 END AS r FROM part)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    v = F.concat(text(F.col("p_size")), F.lit("."), text(k % 9), F.lit("."), text(k % 4), F.when(k % 10 == 3, F.concat(F.lit("-rc."), text(k % 12))).otherwise(""))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), text(k % 60), F.lit("@a")).alias("ref"), F.when(k % 2 == 0, F.concat(F.lit("v"), v)).otherwise(v).alias("tag"), k.alias("k"))
    return p.unionByName(p.select("ref", F.lit("not-a-version").alias("tag"), "k"))


@query("G2_resolve_version", f"WITH {TAGS_SQL} SELECT ref, 'latest' AS constraint, arg_max(v, (a, b, c, r)) AS version FROM tg GROUP BY ref UNION ALL SELECT ref, '>=20.0.0', arg_max(v, (a, b, c, r)) FROM tg WHERE (a, b, c, r) >= (20, 0, 0, 999) GROUP BY ref")
def resolve_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir)
    refs = t.select("ref").distinct()
    return P.resolve_versions(refs.withColumn("constraint", F.explode(F.array(F.lit("latest"), F.lit(">=20.0.0")))), t)


@query("G3_compatible", f"WITH {TAGS_SQL} SELECT v, a = 7 AS same, count(*)::BIGINT AS n FROM tg GROUP BY ALL")
def compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir).where("tag <> 'not-a-version'").select(paths.version_of(F.col("tag")).alias("v"))
    return t.select("v", paths.compatible(F.col("v"), F.lit("7.1")).alias("same")).groupBy("v", "same").agg(F.count("*").alias("n"))


@query("G5_compare", f"WITH {TAGS_SQL} SELECT ref, list(v ORDER BY a, b, c, r) AS versions FROM (SELECT DISTINCT ref, v, a, b, c, r FROM tg) GROUP BY ref")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.valid_tags(tags(spark, sf_dir)).select("ref", "key", paths.version_of(F.col("tag")).alias("v")).distinct()
    return t.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda x: x["v"]).alias("versions"))


#: p1 and p5 are direct; k needs 2k + 1 and 3k + 2, unless it is a multiple of four.
CLOSURE_SQL = f"""RECURSIVE {TAGS_SQL}, cl AS (SELECT k, 0 AS depth FROM (VALUES (1::BIGINT), (5)) t(k)
    UNION SELECT unnest([(2 * k + 1) % 60, (3 * k + 2) % 60]), depth + 1 FROM cl WHERE k % 4 <> 0 AND depth < 10), rs AS (SELECT k, min(depth) AS depth FROM cl GROUP BY k)"""


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tags(spark, sf_dir)
    k = F.col("k") % 60
    name = lambda c: F.concat(F.lit("p"), (c % 60).cast("string"), F.lit("@a"))
    versions = t.where("tag <> 'not-a-version'").select("ref", paths.version_of(F.col("tag")).alias("version"), k.alias("k")).distinct().where("k % 4 <> 0")
    deps = versions.select("ref", "version", F.explode(F.array(name(2 * F.col("k") + 1), name(3 * F.col("k") + 2))).alias("dep_ref"), F.lit(">=0.1.0").alias("constraint"))
    direct = spark.createDataFrame([("p1@a", "latest"), ("p5@a", ">=0.2.0")], "ref string, constraint string")
    return P.resolve(direct, deps, t)


@query("G1_resolve", f"WITH {CLOSURE_SQL} SELECT ref, arg_max(v, (a, b, c, r)) AS version, CASE WHEN any_value(depth) = 0 THEN 'direct' ELSE 'transitive' END AS source FROM rs JOIN tg ON tg.ref = 'p' || k || '@a' GROUP BY ref")
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[0]


@query("G4_lock", f"WITH {CLOSURE_SQL} SELECT ref, 'v' || arg_max(v, (a, b, c, r)) AS tag FROM rs JOIN tg ON tg.ref = 'p' || k || '@a' GROUP BY ref")
def lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[0].select("ref", paths.tag_of(F.col("version")).alias("tag"))


@query("J22_changes", "SELECT s_suppkey AS ref, (s_suppkey % 7)::VARCHAR AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'new' WHEN s_suppkey % 7 = s_suppkey % 2 THEN 'unchanged' ELSE 'updated' END AS change FROM supplier")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"))
    old = s.where("ref % 3 <> 0").select("ref", (F.col("ref") % 2).cast("string").alias("version"))
    return P.classify_changes(s.select("ref", (F.col("ref") % 7).cast("string").alias("version")), old)


@query("J23_missing_from_lock", "SELECT s_suppkey AS ref FROM supplier WHERE s_suppkey % 3 = 0")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"))
    return P.missing_from_lock(s, s.where("ref % 3 <> 0"))


@query("J24_prune_orphans", "SELECT 's' || s_suppkey AS ref, CASE WHEN s_suppkey % 5 = 0 THEN 'direct' ELSE 'transitive' END AS source FROM supplier WHERE s_suppkey <> 1 AND (s_suppkey % 5 = 0 OR s_suppkey % 4 <> 1)")
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages: every fourth is required by s1 alone, the others by s2 as well."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("ref"), F.when(k % 5 == 0, "direct").otherwise("transitive").alias("source"),
        F.when(k % 4 == 1, F.array(F.lit("s1:1.0.0"))).otherwise(F.array(F.lit("s1:1.0.0"), F.lit("s2:1.0.0"))).alias("required_by"),
    )
    return P.prune_orphans(s, "s1").select("ref", "source")


@query("J25_find", "SELECT 'p' || p_partkey % 60 || '@a' AS ref, count(*)::BIGINT AS tags FROM part WHERE p_partkey % 60 IN (7, 8) GROUP BY 1")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir).where("tag <> 'not-a-version'")
    return t.where(F.substring_index("ref", "@", 1).isin("p7", "p8")).groupBy("ref").agg(F.count("*").alias("tags"))
