"""Resuming plans: what has changed under them, and the context of their current steps, for many plans in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import fuse, incremental


def check(dependencies: DataFrame, hashes: DataFrame) -> DataFrame:
    """dependencies: name, at, path, expected. hashes: path, hash. Each with its present hash, whether it is missing, and whether it differs (a missing one does)."""
    now = incremental.drift(dependencies.select("path", F.col("expected").alias("hash")), hashes).select(F.col("dep").alias("path"), "hash").distinct()
    missing = F.col("hash").isNull()
    return dependencies.join(now, "path", "left").select(
        "name", "at", "path", "expected", "hash", missing.alias("missing"), (missing | ~F.col("hash").eqNullSafe(F.col("expected"))).alias("changed")
    )


def replay(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """calls: name, call, ids (a list). chunks: id, source, sequence, type, content, bridge. The text of each call: name, call, document, chunks, absent.

    Of chunks that share an id the one of the least source is taken; an id that is named twice counts once. absent: ids without a chunk;
    where all are absent, the document is null.
    """
    asked = calls.select("name", "call", F.explode(F.array_distinct("ids")).alias("id"))
    wanted = chunks.select("id", "source", "sequence", "type", "content", "bridge").join(asked.select("id").distinct(), "id", "left_semi")
    one = F.min_by(F.struct("source", "sequence", "type", "content", "bridge"), F.struct("source", "sequence"))
    parts = asked.join(wanted.groupBy("id").agg(one.alias("c")), "id", "left").select(F.struct("name", "call").alias("key"), "id", "c")
    texts = fuse.assemble(parts.where("c is not null").select("key", "c.*"), "key")
    absent = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("c").isNull(), F.col("id")))).alias("absent"))
    return absent.join(texts, "key", "left").select("key.*", "document", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), "absent")


def resume(plans: DataFrame, hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    """plans: name (each once), current_step, dependencies and steps, as ``files.load_plans`` gives them. One row for each plan.

    state is 'status' if the plan has no current step, 'drift' if a dependency has changed or is missing, else 'replay'. changed and
    missing: how many (null without a current step); drifted: those, in the plan's order; queries: the step's stored queries, if there is
    drift, to be asked again; replays: the texts of the step's lists of chunks, in order, if there is none; lists without an id give none.
    """
    step = F.when(F.col("current_step") > 0, F.get(F.filter("steps", lambda s: s["id"] == F.col("current_step")), F.lit(0)))
    live = plans.select("name", "dependencies", step.alias("step"))
    needed = live.where("step is not null").select("name", F.posexplode("dependencies").alias("at", "d")).select("name", "at", "d.path", F.col("d.hash").alias("expected"))
    found = check(needed, hashes).groupBy("name").agg(
        F.count_if(F.col("changed") & ~F.col("missing")).alias("changed"), F.count_if("missing").alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct("at", "path", "expected", "hash")))).alias("drifted"),
    )
    rows = live.join(found, "name", "left")
    count = lambda c: F.when(F.col("step").isNotNull(), F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    rows = rows.select("name", "step", count("changed"), count("missing"), "drifted")
    state = F.when(F.col("step").isNull(), "status").when(F.col("changed") + F.col("missing") > 0, "drift").otherwise("replay")
    rows = rows.withColumn("state", state)
    calls = rows.where("state = 'replay'").select("name", F.posexplode("step.chunks").alias("call", "raw"))
    calls = calls.select("name", "call", paths.parse_ids(F.col("raw")).alias("ids")).where(F.size("ids") > 0)
    texts = replay(calls, chunks).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("call", "document", "chunks", "absent"))).alias("replays"))
    drifted = F.when(F.col("state") == "drift", F.col("drifted"))
    return rows.join(texts, "name", "left").select(
        "name", "state", "changed", "missing", drifted.alias("drifted"), F.when(F.col("state") == "drift", F.col("step.queries")).alias("queries"), "replays"
    )
