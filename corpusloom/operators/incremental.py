"""Change detection against an earlier state, and what is kept from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, hash on both sides: path and status new, modified, unchanged or deleted."""
    p = previous.select("path", F.col("hash").alias("before"))
    both = current.select("path", "hash").join(p, "path", "full_outer")
    status = F.when(F.col("hash").isNull(), "deleted").when(F.col("before").isNull(), "new").when(F.col("hash") == F.col("before"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def instructions_changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """name, hash on both sides: name and changed; a side that lacks the name differs."""
    both = current.alias("c").join(previous.alias("p"), F.col("c.name") == F.col("p.name"), "full_outer")
    return both.select(F.coalesce("c.name", "p.name").alias("name"), (~F.col("c.hash").eqNullSafe(F.col("p.hash"))).alias("changed"))


def of_sources(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select(F.col("path").alias("source")), "source", "left_semi")


def stale(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Chunks of sources that aren't unchanged."""
    same = status.where("status = 'unchanged'").select(F.col("path").alias("source"))
    return chunks.join(same, "source", "left_anti")


def kept_aliases(terms: DataFrame, earlier: DataFrame, unchanged: DataFrame) -> DataFrame:
    """terms: key, aliases, chunks. earlier: key, aliases. unchanged: chunk. Aliases are taken over if there are none now, there were, and all chunks are unchanged."""
    rows = terms.select("key", F.explode_outer("chunks").alias("chunk")).join(unchanged.select("chunk", F.lit(True).alias("same")), "chunk", "left")
    all_same = rows.groupBy("key").agg(F.bool_and(F.col("chunk").isNull() | F.coalesce("same", F.lit(False))).alias("all_same"))
    both = terms.join(all_same, "key").join(earlier.select("key", F.col("aliases").alias("old")), "key", "left")
    take = (F.size("aliases") == 0) & (F.coalesce(F.size("old"), F.lit(0)) > 0) & F.col("all_same")
    return both.select("key", F.when(take, F.col("old")).otherwise(F.col("aliases")).alias("aliases"))


def kept_bridges(manifest: DataFrame, earlier: DataFrame, unchanged: DataFrame) -> DataFrame:
    """manifest: id, next, bridge. earlier: id, bridge. unchanged: chunk. A bridge is taken over if it and the next chunk are unchanged."""
    same = unchanged.select("chunk")
    rows = manifest.join(same.select(F.col("chunk").alias("id"), F.lit(True).alias("a")), "id", "left")
    rows = rows.join(same.select(F.col("chunk").alias("next"), F.lit(True).alias("b")), "next", "left").join(earlier.select("id", F.col("bridge").alias("old")), "id", "left")
    return rows.select("id", F.coalesce(F.when(F.col("a") & F.col("b"), F.col("old")), "bridge").alias("bridge"))


def drift(dependencies: DataFrame, hashes: DataFrame) -> DataFrame:
    """dependencies: path, hash. hashes: path, hash. Each one's present hash: of the path, with .md, with /README.md, else of the first file below it."""
    d = dependencies.select(F.col("path").alias("dep"), F.col("hash").alias("expected")).distinct()
    names = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("dep", F.lit(end)).alias("path")) for i, end in enumerate(("", ".md", "/README.md"))])
    exact = d.select("dep", F.explode(names).alias("n")).select("dep", "n.*").join(hashes, "path").select("dep", "rank", "path", "hash")
    # each file lies below each of its folders, so the prefix match is an equality
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = hashes.where(F.col("path").contains("/")).select(F.explode(folders).alias("dep"), "path", "hash").where(F.col("path") != F.concat("dep", F.lit("/")))
    first = below.groupBy("dep").agg(F.min(F.struct("path", "hash")).alias("m")).join(d.select("dep"), "dep", "left_semi")
    found = exact.unionByName(first.select("dep", F.lit(3).alias("rank"), "m.path", "m.hash"))
    best = found.groupBy("dep").agg(F.min_by("hash", F.struct("rank", "path")).alias("hash"))
    rows = d.join(best, "dep", "left")
    return rows.select("dep", "hash", F.col("hash").isNull().alias("missing"), (~F.col("hash").eqNullSafe(F.col("expected"))).alias("changed"))


def union_chunks(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """The chunks of a build and those kept from the last one: a source that was built anew has none of its old chunks. ``fresh`` tells which."""
    old = kept.join(fresh.select("source").distinct(), "source", "left_anti").select(*fresh.columns, F.lit(False).alias("fresh"))
    return fresh.select("*", F.lit(True).alias("fresh")).unionByName(old)
