"""Sinks: envelopes, seen-state snapshots, analysis archive, digest text, latest view.

All writers are distributed writes; nothing is gathered on the driver. State is
versioned (a new folder per version) so the folder being read is never
overwritten, and a retried write replaces exactly its own version.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """One JSON envelope per line (one line per topic), whole-output overwrite."""
    envelopes.select("envelope").write.mode("overwrite").text(path)


def write_seen_snapshot(seen: DataFrame, state_dir: str, version: int) -> str:
    """Seen state as Parquet snapshot ``v=<version>``, rows sorted by url (range
    partitioned, so the sort is distributed). Returns the snapshot path."""
    path = os.path.join(state_dir, f"v={version}")
    seen.orderBy("url").write.mode("overwrite").parquet(path)
    return path


def write_archive(rows: DataFrame, path: str) -> None:
    """Analysis archive partitioned by run_date; a rerun replaces only its own dates."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(path))


def write_digest(lines: DataFrame, path: str) -> None:
    """Digest text per topic folder. The global sort on (topic, block, item, line)
    range-partitions the lines, so part files in name order read back in order."""
    ordered = lines.orderBy("topic", "block", "item", "line")
    ordered.select("topic", "text").write.mode("overwrite").partitionBy("topic").text(path)


def latest_archive(spark: SparkSession, path: str) -> DataFrame:
    """Latest run per topic: its run_date and article count (partial aggregates)."""
    rows = spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))  # partition value, not an inferred date
    per_run = rows.groupBy("topic", "run_date").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("topic").agg(F.max("run_date").alias("latest_run_date"), F.max_by("n", "run_date").alias("n_articles"))
