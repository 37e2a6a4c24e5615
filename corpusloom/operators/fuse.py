"""Rank fusion, graph re-ranking, related chunks, budgets and assembly of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from .index import DIGITS


def weighted_rrf(ranked: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """ranked: query, corpus, doc, rank (from 1). The sum of weight / (k + rank), and sources: corpus to rank."""
    weight: Column = F.lit(1.0)
    for name, w in config.rrf_weights.items():
        weight = F.when(F.col("corpus") == name, F.lit(w)).otherwise(weight)
    part = weight / (config.rrf_k + F.col("rank"))
    fused = ranked.groupBy("query", "doc").agg(
        F.round(F.sum(part), DIGITS).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("corpus", "rank")))).alias("sources")
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
    return fused.withColumn("rank", place.cast("bigint"))


def graph_rerank(fused: DataFrame, manifest: DataFrame, doc_refs: DataFrame, top: int, config: Config = DEFAULTS) -> DataFrame:
    """fused: query, doc, score, rank. manifest: doc, source, previous, next, spec_chunk, parent_object. doc_refs: src, dst.

    A row's score is multiplied by 1 plus a boost for each of: previous, next, spec chunk and parent object in the
    window of the first ceil(top * ratio) ranks; a source that it refers to, or that refers to it, in the window.
    """
    near = fused.where(F.col("rank") <= F.ceil(F.lit(top * config.window_ratio))).select("query", "doc")
    rows = fused.select("query", "doc").join(manifest.select("doc", "source", "previous", "next", "spec_chunk", "parent_object"), "doc")
    links = {"previous": config.adjacent_boost, "next": config.adjacent_boost, "spec_chunk": config.spec_boost, "parent_object": config.spec_boost}
    each = F.explode(F.array(*[F.struct(F.col(c).alias("other"), F.lit(b).alias("boost")) for c, b in links.items()])).alias("l")
    linked = rows.select("query", "doc", each).select("query", "doc", "l.other", "l.boost").where("other is not null")
    linked = linked.join(near.withColumnRenamed("doc", "other"), ["query", "other"], "left_semi").select("query", "doc", "boost")
    # each source with those it refers to (way 0) and those that refer to it (way 1); one of either kind is enough
    ways = doc_refs.select(F.col("src").alias("source"), F.col("dst").alias("there"), F.lit(0).alias("way")).unionByName(
        doc_refs.select(F.col("dst").alias("source"), F.col("src").alias("there"), F.lit(1).alias("way"))
    )
    found = near.join(manifest.select("doc", F.col("source").alias("there")), "doc").select("query", "there").distinct()
    sources = found.join(ways, "there").select("query", "source", "way").distinct()
    crossed = rows.select("query", "doc", "source").join(sources, ["query", "source"]).select("query", "doc", F.lit(config.crossref_boost).alias("boost"))
    boosts = linked.unionByName(crossed).groupBy("query", "doc").agg(F.sum("boost").alias("boost"))
    factor = F.round(1 + F.coalesce("boost", F.lit(0.0)), 2)
    out = fused.select("query", "doc", "score").join(boosts, ["query", "doc"], "left")
    out = out.select("query", "doc", F.round(F.col("score") * factor, DIGITS + 2).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
    return out.withColumn("rank", place.cast("bigint"))


def related(hits: DataFrame, manifest: DataFrame, seen: DataFrame, most: int = DEFAULTS.related) -> DataFrame:
    """The neighbours (previous, then next) of the hits in rank order that aren't seen, the first ``most`` of each query."""
    pairs = hits.join(manifest.select("doc", "previous", "next"), "doc").select("query", "rank", F.posexplode(F.array("previous", "next")).alias("side", "neighbour"))
    new = pairs.where("neighbour is not null").join(seen.select("query", F.col("doc").alias("neighbour")), ["query", "neighbour"], "left_anti")
    first = new.groupBy("query", "neighbour").agg(F.min(F.struct("rank", "side")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at")).cast("bigint")
    return first.select("query", F.col("neighbour").alias("doc"), place.alias("place")).where(F.col("place") <= most)


def select_budget(ranked: DataFrame, budget: int, by: str = "query") -> DataFrame:
    """The first rows whose tokens fit; the first row always, none after one that doesn't fit."""
    total = F.sum("tokens").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", total).where((F.col("rank") == 1) | (F.col("used") <= budget))


def effective_budget(target: Column, multiplier: float = DEFAULTS.prompt_multiplier, delta: Column | None = None) -> Column:
    d = delta if delta is not None else F.lit(0.0)
    return F.greatest(target, F.ceil(target * multiplier * (1 + d))).cast("bigint")


def assemble(rows: DataFrame, by: str = "query") -> DataFrame:
    """rows: by, source, sequence, type, content, bridge. The text of each group in the order (type, source, sequence).

    A section begins where the type changes, a rule stands where the source does; a bridge, if there is one, where
    a source's chunks aren't neighbours.
    """
    kind = F.when(F.col("type") == "system", 1).when(F.col("type") == "spec", 2).otherwise(0)
    rows = rows.withColumn("kind", kind)
    order = Window.partitionBy(by).orderBy("kind", "source", "sequence")
    before = {c: F.lag(c).over(order) for c in ("kind", "source", "sequence", "bridge")}
    rows = rows.select("*", *[v.alias(f"_{k}") for k, v in before.items()], F.row_number().over(order).alias("place"))
    title = F.when(F.col("kind") == 1, "System").when(F.col("kind") == 2, "Reasoning").otherwise("Instructions")
    new = F.col("_kind").isNull() | (F.col("_kind") != F.col("kind"))
    moved = F.col("_source") != F.col("source")
    gap = F.col("_sequence") + 1 != F.col("sequence")
    lead = (
        F.when(new, F.concat(F.lit("\n# "), title, F.lit("\n")))
        .when(moved, F.lit("\n---\n"))
        .when(gap & F.col("_bridge").isNotNull(), F.concat(F.lit("\n---\n> **Context bridge**: "), "_bridge", F.lit("\n---\n")))
        .otherwise("")
    )
    piece = F.concat(lead, F.lit("\n"), "content")
    own = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(own, lambda x: x["piece"]), "").alias("document"), F.count("*").alias("chunks"))


def distinct_sources(rows: DataFrame, by: str = "query") -> DataFrame:
    """Sources in the order of their first row."""
    first = rows.groupBy(by, "source").agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("first")).cast("bigint")).drop("first")


def flatten(ranked: DataFrame, corpora: tuple[str, ...] = ("objects", "specs", "system")) -> DataFrame:
    """ranked: query, corpus, doc, score, rank. The lists of all corpora as one, by score; ties in the order of the lists, then by rank."""
    at: Column = F.lit(len(corpora))
    for i, name in enumerate(corpora):
        at = F.when(F.col("corpus") == name, i).otherwise(at)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), at, "rank"))
    return ranked.select("query", "doc", place.cast("bigint").alias("place"))


def type_rank(kind: Column) -> Column:
    """Objects first, then what belongs to the system, then specs."""
    return F.when(kind == "system", 1).when(kind == "spec", 2).otherwise(0)


def by_type(chunks: DataFrame, by: Column) -> DataFrame:
    """source, sequence and the place of each chunk within its group, by type, source and sequence."""
    order = Window.partitionBy(by).orderBy(type_rank(F.col("type")), "source", "sequence")
    return chunks.select("source", "sequence", F.row_number().over(order).cast("bigint").alias("place"))


def result_count(flag: Column, configured: Column, default: int = 30) -> Column:
    """The flag, or else the configured number, or else the default."""
    return F.coalesce(flag, configured, F.lit(default)).cast("bigint")
