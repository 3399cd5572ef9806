"""Streaming forms of the history (an extension: there is no streaming counterpart to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.state import add_history


def upsert_history(stream: DataFrame, path: str, checkpoint: str, keep: int = 500):
    """USR-01 on a stream of visits: each micro-batch merges into the next version of the table under ``path``.

    Versions are numbered by batch, so a batch that runs again overwrites its own version and nothing else.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{n - 1}") if n else batch.limit(0)
        add_history(old.select(*batch.columns), batch, keep).write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits of a user with no pause longer than ``gap``; events later than ``late`` are out on a stream."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
