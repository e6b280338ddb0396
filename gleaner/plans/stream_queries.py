"""Registered streaming queries: run to completion (availableNow), read the sink back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import discovery as D
from gleaner.plans import fixtures as X
from gleaner.streaming import jobs as J
from gleaner.streaming.buckets import BucketedTable
from gleaner.streaming.runtime import run_available, scratch_dir, to_parquet_sink

TS = "yyyy-MM-dd HH:mm:ss"
EVENT_PARTS = 4


def _docs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file stream source needs a directory or glob; "[t]" matches exactly this file
    path = f"{sf_dir}/documents.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]")


def _entries_stream(spark, sf_dir):
    return X.entries_from(_docs_stream(spark, sf_dir), spark, sf_dir)


def _run_to_table(spark, df: DataFrame, name: str) -> DataFrame:
    base = scratch_dir(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    run_available(to_parquet_sink(df, out, ckpt))
    return spark.read.parquet(out)


def q_stream_recency(spark, sf_dir):
    e = _entries_stream(spark, sf_dir)
    e = e.withColumn("published", D.entry_published(e))
    kept = J.stream_recency(e, X.as_of_col(), X.DAYS).select("pos", F.date_format("published", TS).alias("published"))
    return _run_to_table(spark, kept, "stream-recency")


def q_stream_url_dedup(spark, sf_dir):
    e = D.with_urls(_entries_stream(spark, sf_dir))
    e = e.withColumn("published", D.entry_published(e))
    d = J.stream_url_dedup(e, X.as_of_col(), X.DAYS).select("url")
    return _run_to_table(spark, d, "stream-dedup")


def files_per_batch(df: DataFrame) -> int:
    """Files of a micro-batch: as many as the whole scan has input splits.

    A landing task writes one file, so what it reads follows the size of a split, which Spark bounds."""
    return max(1, df.rdd.getNumPartitions())


def _replayed(df: DataFrame, key: str, name: str, parts: int) -> tuple[str, int]:
    """Land ``df`` split by ``key``; (folder, files of one of ``parts`` micro-batches)."""
    path, files = scratch_dir(df.sparkSession, name), files_per_batch(df)
    df.repartitionByRange(parts * files, key).write.parquet(path)
    return path, files


def replay_events(spark: SparkSession, sf_dir: str, parts: int = EVENT_PARTS) -> tuple[str, int]:
    """Land the events table split by event_id (the stream input), in ``parts`` micro-batches."""
    return _replayed(X.table(spark, sf_dir, "events"), "event_id", "events-landing", parts)


def q_stream_daily_volume(spark, sf_dir):
    src, files = replay_events(spark, sf_dir)
    events = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", files).parquet(src)
    agg = J.stream_daily_volume(events)
    base = scratch_dir(spark, "stream-volume")
    out = os.path.join(base, "out")
    run_available(J.complete_to_parquet(agg, out, os.path.join(base, "_checkpoint")))
    return spark.read.parquet(out)


def q_stream_seen_upsert(spark, sf_dir):
    base = scratch_dir(spark, "stream-seen")
    state = os.path.join(base, "state")
    X.seen(spark, sf_dir).write.parquet(os.path.join(state, "v=0"))
    feeds = X.feeds(spark, sf_dir)

    def select(batch: DataFrame, seen: DataFrame) -> DataFrame:
        c = D.candidates(batch, feeds, X.TOPIC, X.as_of_col(), X.DAYS, seen=seen)
        return D.best_topk(c, cap=X.CAP, limit=X.LIMIT)

    latest = J.stream_seen_upsert(spark, _entries_stream(spark, sf_dir), select, state, os.path.join(base, "_checkpoint"), now=X.as_of_col())
    snap = spark.read.parquet(latest)
    return snap.select("url", F.date_format("first_seen", TS).alias("first_seen"), F.date_format("last_seen", TS).alias("last_seen"),
                       "title", "source", "published")


def replay_documents(spark: SparkSession, sf_dir: str, parts: int = EVENT_PARTS) -> tuple[str, int]:
    """Land the documents split by doc_id, in ``parts`` micro-batches."""
    return _replayed(X.table(spark, sf_dir, "documents"), "doc_id", "documents-landing", parts)


def entries_stream(spark: SparkSession, sf_dir: str, landed: str, files: int = 1) -> DataFrame:
    docs = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", files).parquet(landed)
    return X.entries_from(docs, spark, sf_dir)


def q_stream_url_best(spark, sf_dir):
    """Best candidate per url over replayed batches; equals the batch dedup."""
    feeds, seen = X.feeds(spark, sf_dir), X.seen(spark, sf_dir)
    base = scratch_dir(spark, "stream-best")
    table = BucketedTable(spark, os.path.join(base, "best"), "url", buckets=16)
    scored = lambda batch: D.candidates(batch, feeds, X.TOPIC, X.as_of_col(), X.DAYS, seen=seen)
    J.stream_best_per_url(entries_stream(spark, sf_dir, *replay_documents(spark, sf_dir)), scored, table, os.path.join(base, "_checkpoint"))
    return table.read().select("url", "first_pos", "pos", "source", "discovery_score", "title")


def q_stream_seen_buckets(spark, sf_dir):
    """The seen state in buckets: one batch over all documents, as ``stream_seen_upsert``."""
    base = scratch_dir(spark, "stream-seen-buckets")
    table = BucketedTable(spark, os.path.join(base, "seen"), "url", buckets=16)
    table.create(X.seen(spark, sf_dir))
    feeds = X.feeds(spark, sf_dir)

    def select(batch: DataFrame, seen: DataFrame) -> DataFrame:
        c = D.candidates(batch, feeds, X.TOPIC, X.as_of_col(), X.DAYS, seen=seen)
        return D.best_topk(c, cap=X.CAP, limit=X.LIMIT)

    J.stream_seen_buckets(spark, _entries_stream(spark, sf_dir), select, table, os.path.join(base, "_checkpoint"), now=X.as_of_col())
    return table.read().select("url", F.date_format("first_seen", TS).alias("first_seen"), F.date_format("last_seen", TS).alias("last_seen"),
                               "title", "source", "published")


def q_stream_closed_days(spark, sf_dir):
    """Daily volume of the days that the watermark (one day) has closed, each written once."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    base = scratch_dir(spark, "stream-closed")
    out = os.path.join(base, "out")
    run_available(J.closed_days(J.stream_daily_volume(events), out, os.path.join(base, "_checkpoint")))
    return spark.read.schema("event_type string, n long, day string").parquet(out).select("day", "event_type", "n")


QUERIES = {
    "stream_url_best": q_stream_url_best,
    "stream_seen_buckets": q_stream_seen_buckets,
    "stream_closed_days": q_stream_closed_days,
    "stream_recency": q_stream_recency,
    "stream_url_dedup": q_stream_url_dedup,
    "stream_daily_volume": q_stream_daily_volume,
    "stream_seen_upsert": q_stream_seen_upsert,
}
