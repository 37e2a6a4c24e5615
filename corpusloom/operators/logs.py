"""Logs of queries and generated documents: usage, caches, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(log: DataFrame, by: str) -> DataFrame:
    """log: caller, model, tokens, hit. By caller or model: entries, tokens, hits and the share of all tokens, in percent."""
    rows = log.groupBy(by).agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"), F.count_if("hit").alias("hits"))
    total = rows.agg(F.sum("tokens")).scalar()
    return rows.select(by, "entries", "tokens", "hits", F.round(100 * F.col("tokens") / total, 6).alias("share"))


def totals(log: DataFrame) -> DataFrame:
    t = log.agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"), F.count_if("hit").alias("hits"))
    return t.withColumn("hit_rate", F.round(100 * F.col("hits") / F.col("entries"), 6))


def merge(counters: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    """Adds counters by key."""
    return counters.select(key, "value").unionByName(more.select(key, "value")).groupBy(key).agg(F.sum("value").alias("value"))


def newest(log: DataFrame, n: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    return log.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def prune(log: DataFrame, keep: int, most_bytes: int, by: str, size: str = "bytes", order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest ``keep`` entries of each kind, if all entries take more than most_bytes; else all."""
    total = log.agg(F.sum(size)).scalar()
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return log.withColumn("_place", place).where((total <= most_bytes) | (F.col("_place") <= keep)).drop("_place")


def cache_lookup(log: DataFrame, wanted: DataFrame, files: DataFrame) -> DataFrame:
    """log: chunk_set, compile, file, ts. wanted: chunk_set, compile. The newest logged file that still exists."""
    hits = log.join(wanted, ["chunk_set", "compile"]).join(files, "file", "left_semi")
    return hits.groupBy("chunk_set", "compile").agg(F.max_by("file", F.struct("ts", "file")).alias("file"))


def latest_tokens(log: DataFrame) -> DataFrame:
    """content, tokens: of each content hash the token count that was logged last."""
    return log.groupBy("content").agg(F.max_by("tokens", F.struct("ts", "event_id")).alias("tokens"))


def places(rows: DataFrame, value: str, *tie: str) -> DataFrame:
    """rows and ``place``, from 1 on, by value (a number) downwards, nulls last, then by tie.

    Values are put in bands by their logarithm, at most 1,025; the bands' counts are added up first, so rows are ordered band by band.
    """
    v = F.col(value)
    banded = rows.select("*", F.when(v.isNull(), -1).otherwise(F.floor(F.log2(F.greatest(v, F.lit(0)) + 1) * 16)).cast("int").alias("_band"))
    counts = banded.groupBy("_band").agg(F.count("*").alias("_n"))
    before = counts.select("_band", (F.sum("_n").over(Window.orderBy(F.col("_band").desc())) - F.col("_n")).alias("_before"))  # a row for each band
    own = F.row_number().over(Window.partitionBy("_band").orderBy(v.desc(), *tie))
    return banded.join(F.broadcast(before), "_band").select(*rows.columns, (F.col("_before") + own).cast("bigint").alias("place"))


def breakdown(log: DataFrame, by: str) -> DataFrame:
    """log: by, tokens. Tokens of each caller or model and its place, the most first."""
    return places(log.groupBy(by).agg(F.sum("tokens").alias("tokens")), "tokens", by)


def sizes(files: DataFrame, by: str, content: str = "content") -> DataFrame:
    """Bytes of the files of each folder; null contents have none."""
    return files.groupBy(by).agg(F.sum(F.octet_length(content)).alias("bytes"))


def session_totals(entries: DataFrame, budget: int, by: str = "session") -> DataFrame:
    """entries: by, place, tokens. Tokens, share of the budget in percent, whether they are over it, and the place of the largest (the first on ties)."""
    total = F.sum("tokens")
    return entries.groupBy(by).agg(
        total.alias("tokens"), F.round(100 * total / budget, 6).alias("used"), (total > budget).alias("over"),
        F.max_by("place", F.struct(F.col("tokens"), -F.col("place"))).alias("largest"),
    )


STATES = ("completed", "in_progress", "pending")


def progress(steps: DataFrame) -> DataFrame:
    """steps: plan, step, status. How many steps of each plan are in each state."""
    return steps.groupBy("plan").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def blocked_steps(steps: DataFrame) -> DataFrame:
    """steps: plan, step, status, blocker. Open steps whose blocker, of the same plan, is open too; a blocker that doesn't exist blocks nothing."""
    still = steps.where("status <> 'completed'")
    open_ = still.select("plan", F.col("step").alias("blocker"))
    return still.where("blocker is not null").join(open_, ["plan", "blocker"], "left_semi").select("plan", "step")
