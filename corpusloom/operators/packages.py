"""Versions and dependencies of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import paths
from ..session import cut


def valid_tags(tags: DataFrame) -> DataFrame:
    """ref, tag with its v, and key, which sorts as versions do."""
    t = tags.select("ref", paths.tag_of(F.col("tag")).alias("tag"))
    return t.where(paths.is_semver(F.col("tag"))).select("ref", "tag", paths.semver_key(F.col("tag")).alias("key"))


def resolve_versions(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """wanted: ref, constraint. The highest tag: of all (latest), of those at least the version (>=), or equal to it."""
    return _highest(wanted, valid_tags(tags))


def _highest(wanted: DataFrame, valid: DataFrame) -> DataFrame:
    """valid: as ``valid_tags`` gives them."""
    w = wanted.select("ref", "constraint").distinct()
    least = paths.tag_of(paths.constraint_version(F.col("constraint")))
    w = w.withColumn("valid", (F.col("constraint") == paths.LATEST) | paths.is_semver(least)).withColumn("least", paths.semver_key(least)).where("valid")
    both = w.join(valid, "ref")
    fits = (F.col("constraint") == paths.LATEST) | F.when(F.col("constraint").startswith(">="), F.col("key") >= F.col("least")).otherwise(F.col("key") == F.col("least"))
    best = both.where(fits).groupBy("ref", "constraint").agg(F.max_by("tag", F.struct("key", "tag")).alias("tag"))
    return best.select("ref", "constraint", paths.version_of(F.col("tag")).alias("version"))


def _major(version: Column) -> Column:
    tag = paths.tag_of(version)
    return F.when(paths.is_semver(tag), F.regexp_extract(tag, paths.SEMVER, 1)).otherwise("?")


def resolve(direct: DataFrame, dependencies: DataFrame, tags: DataFrame, depth: int = DEFAULTS.resolver_depth) -> tuple[DataFrame, DataFrame]:
    """direct: ref, constraint. dependencies: ref, version, dep_ref, constraint. The packages, and all constraints met on the way.

    Level by level: a level's dependencies are resolved together, and of several versions of a package the highest
    stands. What is resolved already isn't replaced by an incompatible or lower constraint, and a direct package never.
    """
    # read once, and each but once, whatever the levels
    valid, dependencies = cut(valid_tags(tags).distinct()), cut(dependencies.distinct())
    d = _highest(direct, valid)
    packages = cut(d.groupBy("ref").agg(F.max_by("version", paths.semver_key(paths.tag_of(F.col("version")))).alias("version")).withColumn("source", F.lit("direct")))
    met = direct.select("ref", "constraint", F.lit("direct").alias("by"))
    frontier = packages.select("ref", "version")
    visited = frontier.limit(0).select("ref")
    for _ in range(depth):
        if frontier.isEmpty():
            break
        found = dependencies.join(frontier, ["ref", "version"]).select(F.col("dep_ref").alias("to"), "constraint", F.concat("ref", F.lit(":"), "version").alias("by"))
        found = cut(found.withColumnRenamed("to", "ref"))
        met = met.unionByName(found.select("ref", "constraint", "by"))
        visited = visited.union(frontier.select("ref")).distinct()
        have = packages.select("ref", F.col("version").alias("old"), "source")
        rows = found.select("ref", "constraint").distinct().join(have, "ref", "left")
        asked = paths.constraint_version(F.col("constraint"))
        higher = paths.semver_key(paths.tag_of(F.col("old"))) < paths.semver_key(paths.tag_of(asked))
        due = rows.where(F.col("old").isNull() | ((F.col("source") != "direct") & paths.compatible(F.col("old"), asked) & higher))
        new = _highest(due.select("ref", "constraint"), valid)
        new = cut(new.groupBy("ref").agg(F.max_by("version", paths.semver_key(paths.tag_of(F.col("version")))).alias("version")).withColumn("source", F.lit("transitive")))
        packages = cut(packages.join(new.select("ref"), "ref", "left_anti").unionByName(new))
        frontier = cut(new.select("ref", "version").join(visited, "ref", "left_anti"))
    return packages, cut(met.distinct())


def conflicts(met: DataFrame) -> DataFrame:
    """Packages of which two requesters ask for different majors, or for something that isn't a version."""
    rows = met.groupBy("ref").agg(
        F.count("*").alias("n"), F.countDistinct(_major(paths.constraint_version(F.col("constraint")))).alias("majors"),
        F.bool_or(_major(paths.constraint_version(F.col("constraint"))) == "?").alias("odd"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("by", "constraint")))).alias("versions"),
    )
    return rows.where((F.col("n") > 1) & ((F.col("majors") > 1) | F.col("odd"))).select("ref", "versions")


def required_by(packages: DataFrame, met: DataFrame) -> DataFrame:
    by = met.where("by <> 'direct'").groupBy("ref").agg(F.array_sort(F.collect_set("by")).alias("required_by"))
    return packages.join(by, "ref", "left")


def classify_changes(resolved: DataFrame, lock: DataFrame) -> DataFrame:
    """ref, version on both sides: new, updated or unchanged."""
    both = resolved.select("ref", "version").join(lock.select("ref", F.col("version").alias("old")), "ref", "left")
    return both.select("ref", "version", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("version"), "unchanged").otherwise("updated").alias("change"))


def missing_from_lock(declared: DataFrame, lock: DataFrame) -> DataFrame:
    """The lock is current if this is empty."""
    return declared.join(lock.select("ref"), "ref", "left_anti")


def prune_orphans(packages: DataFrame, removed: str) -> DataFrame:
    """packages: ref, source, required_by. Without ``removed`` and what only it required; one level."""
    left = F.filter("required_by", lambda x: F.substring_index(x, ":", 1) != removed)
    rows = packages.where(F.col("ref") != removed).withColumn("left", left)
    return rows.where((F.col("source") == "direct") | (F.size("left") > 0)).select("ref", "source", F.col("left").alias("required_by"))


def installable(found: DataFrame, by: str, name: str) -> DataFrame:
    """found: by, name, released, tagged. priority (0 with a release, 1 with a tag only, else 2) and the place among the results of its search."""
    rows = found.withColumn("priority", F.when(F.col("released"), 0).when(F.col("tagged"), 1).otherwise(2).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("priority", name))
    return rows.select(by, name, "priority", place.cast("bigint").alias("place"))
