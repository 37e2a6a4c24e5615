"""Plans: each document has one, whose step replays the document's chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import resume as R
from ..registry import query
from ..sources.adapters import CHUNKS_SQL, chunks, sources


def document_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth plan knows another text of its document, every sixth needs a file that doesn't exist; two of five have no current step."""
    own = chunks(spark, sf_dir).groupBy(F.col("source").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("id")), " , ").alias("ids"))
    d, k = sources(spark, sf_dir).join(own, "path", "left"), F.col("doc_id")
    digest = F.sha2(F.when(k % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256)
    first = F.struct("path", digest.alias("hash"))
    gone = F.struct(F.lit("nowhere").alias("path"), F.lit("none").alias("hash"))
    step = F.struct(
        F.lit(1).alias("id"), F.array(F.concat(F.lit("q"), k.cast("string"))).alias("queries"), F.array(F.lit(" , "), F.coalesce("ids", F.lit(""))).alias("chunks")
    )
    return d.select(
        F.concat(F.lit("p"), k.cast("string")).alias("name"), F.when(k % 5 == 1, 0).when(k % 5 == 2, 7).otherwise(1).alias("current_step"),
        F.when(k % 6 == 0, F.array(first, gone)).otherwise(F.array(first)).alias("dependencies"), F.array(step).alias("steps"),
    )


@query(
    "S11_resume",
    f"""WITH {CHUNKS_SQL}, own AS (SELECT id, arg_min((source, sequence, type, content), (source, sequence)) AS c FROM chk GROUP BY id),
        pl AS (SELECT 'p' || doc_id AS name, doc_id, path, (doc_id % 4 = 0)::BIGINT AS ch, (doc_id % 6 = 0)::BIGINT AS mi,
            CASE WHEN doc_id % 5 IN (1, 2) THEN 'status' WHEN doc_id % 4 = 0 OR doc_id % 6 = 0 THEN 'drift' ELSE 'replay' END AS state FROM src),
        g AS (SELECT name, struct_extract(c, 1) AS source, struct_extract(c, 2) AS sequence, struct_extract(c, 4) AS content, CASE struct_extract(c, 3) WHEN 'system' THEN 1 WHEN 'spec' THEN 2 ELSE 0 END AS kind
            FROM (SELECT DISTINCT name, id FROM pl JOIN chk ON chk.source = pl.path WHERE state = 'replay') JOIN own USING (id)),
        l AS (SELECT *, lag(kind) OVER o AS k0, lag(source) OVER o AS s0, row_number() OVER o AS place FROM g WINDOW o AS (PARTITION BY name ORDER BY kind, source, sequence)),
        tx AS (SELECT name, count(*)::BIGINT AS chunks, sha256(string_agg(CASE WHEN k0 IS NULL OR k0 <> kind THEN chr(10) || '# ' || ['Instructions', 'System', 'Reasoning'][kind + 1] || chr(10)
            WHEN s0 <> source THEN chr(10) || '---' || chr(10) ELSE '' END || chr(10) || content, '' ORDER BY place)) AS digest FROM l GROUP BY name)
        SELECT name, state, CASE WHEN state <> 'status' THEN ch END AS changed, CASE WHEN state <> 'status' THEN mi END AS missing,
            CASE WHEN state = 'drift' THEN 'q' || doc_id END AS queries, chunks, digest FROM pl LEFT JOIN tx USING (name)""",
)
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = sources(spark, sf_dir).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    out = R.resume(document_plans(spark, sf_dir), hashes, chunks(spark, sf_dir).withColumn("bridge", F.lit(None).cast("string")))
    text = F.get("replays", F.lit(0))
    return out.select(
        "name", "state", "changed", "missing", F.array_join("queries", ",").alias("queries"), text["chunks"].alias("chunks"),
        F.sha2(text["document"].cast("binary"), 256).alias("digest"),
    )
