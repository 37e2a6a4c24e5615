"""Change detection, drift, and the logs, with events standing for log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, logs
from ..registry import query
from ..sources.adapters import table

#: An earlier state of the documents: every tenth edited, every twentieth missing; ten more in a hundred that are gone now.
NOW_SQL = "now AS (SELECT 'd' || doc_id AS path, sha256(text) AS hash FROM documents)"
THEN_SQL = NOW_SQL + """, thn AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 20 <> 7
    UNION ALL SELECT 'gone' || doc_id, sha256(text) FROM documents WHERE doc_id % 10 = 1)"""
STATUS_SQL = THEN_SQL + """, st AS (SELECT coalesce(now.path, thn.path) AS path, CASE WHEN now.hash IS NULL THEN 'deleted' WHEN thn.hash IS NULL THEN 'new'
    WHEN now.hash = thn.hash THEN 'unchanged' ELSE 'modified' END AS status FROM now FULL JOIN thn ON now.path = thn.path)"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    now = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), sha(F.col("text")).alias("hash"), "doc_id")
    edited = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    then = d.where("doc_id % 20 <> 7").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), sha(edited).alias("hash"))
    gone = d.where("doc_id % 10 = 1").select(F.concat(F.lit("gone"), F.col("doc_id").cast("string")).alias("path"), sha(F.col("text")).alias("hash"))
    return now, then.unionByName(gone)


@query("J8_classify_files", f"WITH {STATUS_SQL} SELECT path, status FROM st")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.classify(*states(spark, sf_dir))


@query("U3_deleted", f"WITH {THEN_SQL} SELECT path FROM thn EXCEPT SELECT path FROM now")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = states(spark, sf_dir)
    return then.select("path").exceptAll(now.select("path"))


@query("J9_instructions", "SELECT n_nationkey::VARCHAR AS name, n_nationkey % 3 <> 0 AS changed FROM nation")
def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for folders: of three one is the same, one differs, one lacks an earlier hash."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("hash"), "n_nationkey")
    before = n.where("n_nationkey % 3 <> 2").select("name", F.when(F.col("n_nationkey") % 3 == 1, F.concat("hash", F.lit("?"))).otherwise(F.col("hash")).alias("hash"))
    return incremental.instructions_changed(n.select("name", "hash"), before)


@query("J10_kept_chunks", f"WITH {STATUS_SQL} SELECT doc_id FROM documents WHERE 'd' || doc_id IN (SELECT path FROM st WHERE status = 'unchanged')")
def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = states(spark, sf_dir)
    same = incremental.classify(now, then).where("status = 'unchanged'")
    return incremental.of_sources(now.withColumnRenamed("path", "source"), same).select("doc_id")


@query("J11_stale_chunks", f"WITH {STATUS_SQL} SELECT doc_id FROM documents WHERE 'd' || doc_id NOT IN (SELECT path FROM st WHERE status = 'unchanged')")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = states(spark, sf_dir)
    return incremental.stale(now.withColumnRenamed("path", "source"), incremental.classify(now, then)).select("doc_id")


@query(
    "J12_kept_aliases",
    """WITH u AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0), t AS (SELECT s_nationkey AS key, list(s_suppkey ORDER BY s_suppkey) AS c FROM supplier GROUP BY 1)
       SELECT key::VARCHAR AS key, CASE WHEN key % 4 = 1 THEN ['own'] WHEN key % 2 = 0 AND NOT list_bool_or(list_transform(c, lambda x: x % 7 = 0)) THEN ['old' || key] ELSE []::VARCHAR[] END AS aliases FROM t""",
)
def kept_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for terms, their suppliers for chunks."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_nationkey")
    none = F.array().cast("array<string>")
    terms = s.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("chunks"))
    terms = terms.select(key.cast("string").alias("key"), F.when(key % 4 == 1, F.array(F.lit("own"))).otherwise(none).alias("aliases"), "chunks")
    earlier = s.select("s_nationkey").distinct().select(key.cast("string").alias("key"), F.when(key % 2 == 0, F.array(F.concat(F.lit("old"), key.cast("string")))).otherwise(none).alias("aliases"))
    same = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").cast("string").alias("chunk"))
    return incremental.kept_aliases(terms, earlier, same)


@query(
    "J13_kept_bridges",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 AND (p_partkey + 1) % 5 <> 0 AND p_partkey + 1 <= m AND p_partkey % 2 = 0 THEN 'old' || p_partkey
         WHEN p_partkey % 3 = 0 THEN 'new' || p_partkey END AS bridge FROM part, (SELECT max(p_partkey) AS m FROM part)""",
)
def kept_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    name = lambda w: F.concat(F.lit(w), F.col("id").cast("string"))
    manifest = p.select("id", (F.col("id") + 1).alias("next"), F.when(F.col("id") % 3 == 0, name("new")).alias("bridge"))
    earlier = p.where("id % 2 = 0").select("id", name("old").alias("bridge"))
    return incremental.kept_bridges(manifest, earlier, p.where("id % 5 <> 0").select(F.col("id").alias("chunk")))


@query(
    "J19_drift",
    """WITH h AS (SELECT 'f' || (doc_id // 10) || '/x' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '/README.md' ELSE '' END AS path, sha256(text) AS hash FROM documents),
        d AS (SELECT 'f' || (doc_id // 10) || '/x' || doc_id AS dep, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS expected FROM documents
              UNION ALL SELECT DISTINCT 'f' || (doc_id // 10), 'none' FROM documents UNION ALL SELECT 'nowhere', 'none'),
        m AS (SELECT dep, expected, hash FROM d LEFT JOIN h ON h.path IN (dep, dep || '.md', dep || '/README.md') WHERE dep LIKE '%/%'
              UNION ALL SELECT dep, expected, (SELECT arg_min(hash, path) FROM h WHERE starts_with(path, dep || '/')) FROM d WHERE dep NOT LIKE '%/%')
        SELECT dep, hash, hash IS NULL AS missing, hash IS DISTINCT FROM expected AS changed FROM m""",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 10).cast("string"))
    base = F.concat(folder, F.lit("/x"), F.col("doc_id").cast("string"))
    end = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, "/README.md").otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    hashes = d.select(F.concat(base, end).alias("path"), sha(F.col("text")).alias("hash"))
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    deps = d.select(base.alias("path"), sha(edited).alias("hash")).unionByName(d.select(folder.alias("path"), F.lit("none").alias("hash")).distinct())
    return incremental.drift(deps.unionByName(spark.createDataFrame([("nowhere", "none")], "path string, hash string")), hashes)


@query("A22_drift_counters", "SELECT count(*) FILTER (doc_id % 5 = 0)::BIGINT AS changed, count(*) FILTER (doc_id % 5 <> 0)::BIGINT AS same FROM documents")
def drift_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift(spark, sf_dir).where(F.col("dep").contains("/"))
    return found.agg(F.count_if(F.col("changed") & ~F.col("missing")).alias("changed"), F.count_if(~F.col("changed")).alias("same"))


EVENTS_SQL = "ev AS (SELECT event_id, ts, 'user' || user_id % 20 AS caller, event_type AS model, floor(value * 100)::BIGINT AS tokens, event_type = 'click' AS hit FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("caller"), F.col("event_type").alias("model"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tokens"), (F.col("event_type") == "click").alias("hit"),
    )


for _by in ("caller", "model"):
    query(
        f"A17_usage_by_{_by}",
        f"""WITH {EVENTS_SQL} SELECT {_by}, count(*)::BIGINT AS entries, sum(tokens)::BIGINT AS tokens, count(*) FILTER (hit)::BIGINT AS hits,
            round(100 * sum(tokens) / sum(sum(tokens)) OVER (), 6) AS share FROM ev GROUP BY {_by}""",
    )(lambda spark, sf_dir, by=_by: logs.usage(log(spark, sf_dir), by))


@query("A19_usage_totals", f"WITH {EVENTS_SQL} SELECT count(*)::BIGINT AS entries, sum(tokens)::BIGINT AS tokens, count(*) FILTER (hit)::BIGINT AS hits, round(100 * count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM ev")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.totals(log(spark, sf_dir))


@query("A18_merge_counters", f"WITH {EVENTS_SQL} SELECT caller AS key, sum(tokens)::BIGINT AS value FROM ev GROUP BY caller")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: log(spark, sf_dir).where(F.col("event_id") % 2 == k).groupBy(F.col("caller").alias("key")).agg(F.sum("tokens").alias("value"))
    return logs.merge(part(0), part(1))


@query("L7_newest", f"WITH {EVENTS_SQL} SELECT event_id, caller, tokens FROM ev ORDER BY ts DESC, event_id DESC LIMIT 30")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.newest(log(spark, sf_dir), 30).select("event_id", "caller", "tokens")


@query("L6_prune", f"WITH {EVENTS_SQL} SELECT event_id, model FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS n FROM ev) WHERE n <= 5")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.prune(log(spark, sf_dir), 5, 1000, "model", "tokens").select("event_id", "model")


@query("L8_breakdown", f"WITH {EVENTS_SQL} SELECT caller, sum(tokens)::BIGINT AS tokens, row_number() OVER (ORDER BY sum(tokens) DESC, caller) AS place FROM ev GROUP BY caller")
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.breakdown(log(spark, sf_dir), "caller")


@query(
    "J20_cache_lookup",
    f"""WITH {EVENTS_SQL} SELECT caller AS chunk_set, model AS compile, arg_max('f' || event_id, (ts, 'f' || event_id)) AS file FROM ev
        WHERE event_id % 3 <> 0 AND caller IN (SELECT caller FROM ev WHERE event_id % 50 = 0) AND model = 'view' GROUP BY ALL""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).select(F.col("caller").alias("chunk_set"), F.col("model").alias("compile"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), "ts", "event_id")
    wanted = e.where("event_id % 50 = 0").select("chunk_set", F.lit("view").alias("compile")).distinct()
    return logs.cache_lookup(e, wanted, e.where("event_id % 3 <> 0").select("file"))


@query("J21_latest_tokens", f"WITH {EVENTS_SQL} SELECT caller AS content, arg_max(tokens, (ts, event_id)) AS tokens FROM ev GROUP BY caller")
def latest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest_tokens(log(spark, sf_dir).withColumnRenamed("caller", "content"))


@query("A24_sizes", "SELECT lang, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sizes(table(spark, sf_dir, "documents"), "lang", "text")


@query("A21_budget_totals", "SELECT conv_id, sum(n)::BIGINT AS tokens, round(100 * sum(n) / 3000, 6) AS used, sum(n) > 3000 AS over, arg_max(turn, (n, -turn)) AS largest FROM (SELECT conv_id, turn, ceil(strlen(text) / 4)::BIGINT AS n FROM conversations) GROUP BY conv_id")
def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a session: tokens, share of the budget, and the largest (the first on ties)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.ceil(F.octet_length("text") / 4).alias("tokens"))
    return logs.session_totals(c, 3000, "conv_id")


PLAN_SQL = "st AS (SELECT o_custkey AS plan, o_orderkey AS step, ['completed', 'in_progress', 'pending'][1 + (o_orderkey % 3)::INT] AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS blocker FROM orders)"


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stand for the steps of a plan, each blocked by the one before."""
    from pyspark.sql import Window

    status = F.element_at(F.array(F.lit("completed"), F.lit("in_progress"), F.lit("pending")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("step"), status.alias("status"), before.alias("blocker"))


@query("A20_progress", f"WITH {PLAN_SQL} SELECT plan, count(*) FILTER (status = 'completed')::BIGINT AS completed, count(*) FILTER (status = 'in_progress')::BIGINT AS in_progress, count(*) FILTER (status = 'pending')::BIGINT AS pending FROM st GROUP BY plan")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.progress(plan_steps(spark, sf_dir))


@query("W9_blocked_steps", f"WITH {PLAN_SQL} SELECT a.plan, a.step FROM st a JOIN st b ON a.plan = b.plan AND a.blocker = b.step WHERE a.status <> 'completed' AND b.status <> 'completed'")
def blocked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.blocked_steps(plan_steps(spark, sf_dir))
