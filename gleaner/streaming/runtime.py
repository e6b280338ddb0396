"""Shared helpers for streaming jobs: event time, scratch folders, run-to-completion."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir

EPOCH_NTZ = "1970-01-01 00:00:00"


def utc_instant(ts_ntz) -> Column:
    """UTC wall-clock TIMESTAMP_NTZ -> TIMESTAMP instant, independent of the session
    time zone (watermarks need TIMESTAMP; parquet gives TIMESTAMP_NTZ)."""
    c = F.col(ts_ntz) if isinstance(ts_ntz, str) else ts_ntz
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c))


def utc_day(ts) -> Column:
    """Calendar day (UTC) of a TIMESTAMP instant, as 'yyyy-MM-dd'."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int")).cast("string")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir
    on a cluster: spark.checkpoint.dir is the cluster's shared folder)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def run_available(stream_writer, timeout_s: int | None = None) -> None:
    """Start with trigger(availableNow), wait until every available file is processed (no time limit by default)."""
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {q.name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def to_parquet_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: list[str] | None = None):
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w
