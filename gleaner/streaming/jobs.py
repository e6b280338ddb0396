"""Streaming forms of the incremental behaviour (state across runs).

* ``stream_recency``: watermark on the publish time bounds state; the explicit
  as-of filter is the semantics (entries older than ``days`` are dropped).
* ``stream_url_dedup``: first arrival per url within the watermark.
* ``stream_best_per_url``: best score per url in a bucketed table; a better late entry
  replaces the one before it, entries past their time to live leave.
* ``stream_daily_volume``: tumbling one-day windows per type; ``closed_days`` appends each
  day once, when the watermark has passed it, and its state goes.
* ``stream_seen_buckets``: the seen state in a bucketed table; a batch writes only the
  buckets of its own urls.
* ``stream_seen_upsert``: each micro-batch selects against seen-state snapshot
  *n* and writes snapshot *n+1* to a new folder whose name also says which query
  and batch it holds. A retried batch finds its own name and changes nothing; another
  query (a fresh checkpoint) goes on from the newest snapshot. The folder being
  read is never overwritten.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.operators.discovery import url_dedup_best
from gleaner.session import ensure_checkpoint_dir
from gleaner.streaming.buckets import BucketedTable, batch_mark
from gleaner.streaming.runtime import run_available, to_parquet_sink, utc_day, utc_instant


def stream_recency(entries: DataFrame, as_of: Column, days: int = C.DEFAULT_DAYS, published: str = "published") -> DataFrame:
    """Entries with an event-time watermark of ``days``; dated entries older than as_of - days dropped."""
    e = entries.withColumn("_event_time", utc_instant(F.coalesce(F.col(published), as_of)))
    e = e.withWatermark("_event_time", f"{days} days")
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return e.where(F.col(published).isNull() | (F.col(published) >= cutoff))


def stream_url_dedup(entries: DataFrame, as_of: Column, days: int = C.DEFAULT_DAYS, published: str = "published") -> DataFrame:
    """One row per url within the watermark (first arrival wins, not best score)."""
    e = entries.withColumn("_event_time", utc_instant(F.coalesce(F.col(published), as_of)))
    return e.withWatermark("_event_time", f"{days} days").dropDuplicatesWithinWatermark(["url"])


def stream_daily_volume(events: DataFrame, ts: str = "ts", key: str = "event_type", lateness: str = "1 day") -> DataFrame:
    """Per-day, per-key event counts over tumbling windows."""
    e = events.withColumn("_event_time", utc_instant(F.col(ts))).withWatermark("_event_time", lateness)
    g = e.groupBy(F.window("_event_time", "1 day").alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(utc_day(F.col("w.start")).alias("day"), F.col(key), "n")


def committed_snapshots(spark: SparkSession, state_dir: str) -> dict[int, str]:
    """Version -> folder name of every committed snapshot under state_dir."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return {}
    found = {}
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            found[int(name[2:].split("-")[0])] = name
    return found


def latest_snapshot_version(spark: SparkSession, state_dir: str) -> int:
    """Highest committed snapshot version under state_dir, -1 without any."""
    return max(committed_snapshots(spark, state_dir), default=-1)


def latest_snapshot(spark: SparkSession, state_dir: str) -> str:
    found = committed_snapshots(spark, state_dir)
    return os.path.join(state_dir, found[max(found)])


def stream_seen_upsert(spark: SparkSession, entries_stream: DataFrame, select_fn, state_dir: str, checkpoint: str,
                       now: Column | None = None, timeout_s: int | None = None) -> str:
    """Run the discovery-and-remember loop over a stream of entries.

    ``select_fn(batch_df, seen_df) -> selected`` returns the batch's selected
    candidates (url, title, source, published, rank). Snapshot ``v=0`` must exist
    under ``state_dir``. Returns the path of the newest snapshot.
    """
    from gleaner.operators.state import seen_upsert

    stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")

    def process(batch: DataFrame, batch_id: int) -> None:
        found = committed_snapshots(spark, state_dir)
        # the id of a streaming query is kept in its checkpoint: stable over its restarts
        mark = f"-{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        if any(name.endswith(mark) for name in found.values()):
            return  # already committed: a retried batch changes nothing
        current = max(found)
        seen = spark.read.parquet(os.path.join(state_dir, found[current]))
        merged = seen_upsert(seen, select_fn(batch, seen), stamp)
        merged.write.mode("overwrite").parquet(os.path.join(state_dir, f"v={current + 1}{mark}"))

    w = entries_stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    run_available(w, timeout_s)
    return latest_snapshot(spark, state_dir)


def stream_seen_buckets(spark: SparkSession, entries_stream: DataFrame, select_fn, table: BucketedTable, checkpoint: str,
                        now: Column | None = None, timeout_s: int | None = None) -> int:
    """Discovery-and-remember over a stream, the seen state in a bucketed table (key ``url``, made before).

    ``select_fn(batch_df, seen_df) -> selected`` as for ``stream_seen_upsert``. Returns the newest version."""
    from gleaner.operators.state import seen_upsert

    stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")

    def process(batch: DataFrame, batch_id: int) -> None:
        mark = batch_mark(batch, batch_id)
        if not table.committed(mark):
            ensure_checkpoint_dir(spark)
            selected = select_fn(batch, table.read()).checkpoint(eager=True)
            table.update(selected, lambda old, new: seen_upsert(old, new, stamp), mark)

    run_available(entries_stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint), timeout_s)
    return max(table.versions())


def best_per_url(old: DataFrame, new: DataFrame, since: Column | None = None) -> DataFrame:
    """One row per url of both: the best score, at a tie the smallest ``pos``; ``first_pos`` over all.

    ``since`` (an ISO time) is the time to live: dated rows published before it leave."""
    rows = old.unionByName(new.select(old.columns))
    if since is not None:
        rows = rows.where((F.col("published") == "") | (F.col("published") >= since))
    rest = [c for c in old.columns if c not in ("url", "first_pos", "discovery_score", "pos")]
    best = F.max(F.struct("discovery_score", (-F.col("pos")).alias("neg_pos"), *rest, "pos"))
    one = rows.groupBy("url").agg(best.alias("b"), F.min("first_pos").alias("first_pos"))
    return one.select("url", "first_pos", *[F.col("b")[c].alias(c) for c in ("pos", *rest, "discovery_score")])


def stream_best_per_url(entries_stream: DataFrame, candidates_of, table: BucketedTable, checkpoint: str,
                        since: Column | None = None, timeout_s: int | None = None) -> int:
    """Keep the best candidate per url over a stream (key ``url``; the table is made by the first batch).

    ``candidates_of(batch_df)`` gives scored candidates. A batch is reduced to one row per url by
    a partial aggregate where it is read, so a hot url is one row per task, and then merged into
    the buckets of its urls. Returns the newest version."""

    def process(batch: DataFrame, batch_id: int) -> None:
        mark = batch_mark(batch, batch_id)
        ensure_checkpoint_dir(batch.sparkSession)
        fresh = url_dedup_best(candidates_of(batch)).checkpoint(eager=True)
        table.create(fresh.limit(0))
        table.update(fresh, lambda old, new: best_per_url(old, new, since), mark)

    run_available(entries_stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint), timeout_s)
    return max(table.versions())


def closed_days(volume: DataFrame, path: str, checkpoint: str):
    """Append-mode sink of ``stream_daily_volume``: a day is written once, to its own partition, when it has closed."""
    return to_parquet_sink(volume, path, checkpoint, partition_by=["day"])


def complete_to_parquet(agg: DataFrame, path: str, checkpoint: str):
    """Complete-mode aggregate rewritten as a whole after every micro-batch."""
    return (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, _id: df.write.mode("overwrite").parquet(path)))


__all__ = [
    "stream_recency", "stream_url_dedup", "stream_daily_volume", "stream_seen_upsert", "latest_snapshot_version",
    "to_parquet_sink", "run_available", "complete_to_parquet", "stream_seen_buckets", "stream_best_per_url", "best_per_url", "closed_days",
]
