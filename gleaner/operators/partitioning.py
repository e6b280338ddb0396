"""Parallelism guard for CPU-heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
TASK_BYTES = 4 << 20


def spread(df: DataFrame, min_partitions: int | None = None, heavy: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """At least one partition per core before CPU-heavy per-row work.

    A Parquet file with one row group is one input split: a page table of a few
    MB would be parsed by a single task. Large inputs already have far more
    splits than cores, so this is a no-op there (no shuffle is added); only a
    scan with fewer partitions than the cluster's parallelism is redistributed
    (round-robin, no key, so no skew). Streaming DataFrames are left alone.

    ``heavy`` names the text column that the work goes through. Its bytes are summed
    first (a scan of that column), and a partition gets about ``task_bytes`` of them: a
    task's time then stays the same however large the table is and however well its
    files are compressed.
    """
    if df.isStreaming:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if heavy is not None:
        size = df.agg(F.sum(F.octet_length(heavy).cast("long"))).first()[0] or 0
        target = max(target, -(-size // task_bytes))
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only if it has been counted to be small; else leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
