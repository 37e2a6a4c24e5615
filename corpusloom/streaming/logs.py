"""Log roll-ups and change detection over streams. Additions: the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(log: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """log: ts (timestamp), caller, tokens. Entries and tokens by window and caller; later entries than ``late`` are left out."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "caller")
    return rows.agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens")).select("window.start", "window.end", "caller", "entries", "tokens")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "caller")
    return rows.agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens")).select("s.start", "s.end", "caller", "entries", "tokens")


def merge_hashes(path: str):
    """For foreachBatch over (path, hash, ts): a table with the newest hash of each path, whatever batch brings it.

    Each epoch writes the next state beside the last one and then deletes the one before that, so an epoch that is run again finds its
    predecessor. Of equal times the greater hash stands.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("path", "hash", "ts")
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{epoch - 1}"))
        newest = F.max(F.struct("ts", "hash")).alias("m")
        rows.groupBy("path").agg(newest).select("path", "m.hash", "m.ts").write.mode("overwrite").parquet(f"{path}/{epoch}")
        if epoch > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{epoch - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return run
