"""Streaming jobs: a stream replayed in several micro-batches equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans import stream_queries as SQ
from gleaner.plans import fixtures as X
from gleaner.operators import discovery as D
from tests.conftest import SF0001


def test_daily_volume_multi_batch_equals_batch(spark):
    got = {(r["day"], r["event_type"]): r["n"] for r in SQ.q_stream_daily_volume(spark, SF0001).collect()}
    ev = X.table(spark, SF0001, "events")
    exp = {(r["day"], r["event_type"]): r["n"] for r in
           ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp


def test_stream_recency_equals_batch(spark):
    got = sorted(r["pos"] for r in SQ.q_stream_recency(spark, SF0001).collect())
    e = X.entries(spark, SF0001)
    e = e.withColumn("published", D.entry_published(e))
    exp = sorted(r["pos"] for r in D.recency_filter(e, X.as_of_col(), X.DAYS).select("pos").collect())
    assert got == exp


def test_seen_snapshots_versioned_and_idempotent(spark):
    import os

    from gleaner.plans import stream_queries as SQ2
    from gleaner.streaming import jobs as J
    from gleaner.streaming.runtime import scratch_dir

    base = scratch_dir(spark, "test-seen")
    state = os.path.join(base, "state")
    X.seen(spark, SF0001).write.parquet(os.path.join(state, "v=0"))
    feeds = X.feeds(spark, SF0001)

    def select(batch, seen):
        c = D.candidates(batch, feeds, X.TOPIC, X.as_of_col(), X.DAYS, seen=seen)
        return D.capped_topk(D.url_dedup_best(c), cap=X.CAP, limit=X.LIMIT)

    ckpt = os.path.join(base, "_checkpoint")
    first = J.stream_seen_upsert(spark, SQ2._entries_stream(spark, SF0001), select, state, ckpt, now=X.as_of_col())
    assert "/v=1-" in first
    n1 = spark.read.parquet(first).count()
    # restarting with the same checkpoint and no new files commits nothing new
    again = J.stream_seen_upsert(spark, SQ2._entries_stream(spark, SF0001), select, state, ckpt, now=X.as_of_col())
    assert again == first and spark.read.parquet(again).count() == n1
    # a fresh checkpoint on the old state goes on from the newest snapshot
    fresh = J.stream_seen_upsert(spark, SQ2._entries_stream(spark, SF0001), select, state, ckpt + "2", now=X.as_of_col())
    assert "/v=2-" in fresh and spark.read.parquet(fresh).count() > n1
    assert spark.read.parquet(os.path.join(state, "v=0")).count() == X.seen(spark, SF0001).count()


CAND = "pos long, url string, title string, content string, source string, source_type string, published string, tags array<string>, discovery_score int"


def _cand(pos, url, score, title, published=""):
    return (pos, url, title, "c", "s", "feed", published, ["x"], score)


def _land(spark, path, rows):
    spark.createDataFrame(rows, CAND).coalesce(1).write.mode("append").parquet(path)


def _best(spark, base, **kw):
    from gleaner.streaming import jobs as J
    from gleaner.streaming.buckets import BucketedTable

    table = BucketedTable(spark, f"{base}/best", "url", buckets=8)
    stream = spark.readStream.schema(CAND).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    J.stream_best_per_url(stream, lambda b: b, table, f"{base}/_checkpoint", **kw)
    return table


def test_a_better_late_entry_replaces_the_first_one(spark):
    from gleaner.streaming.runtime import scratch_dir

    base = scratch_dir(spark, "test-best")
    all_rows = [[_cand(1, "a", 10, "first"), _cand(2, "b", 50, "b")], [_cand(3, "a", 90, "better"), _cand(4, "c", 5, "c")], [_cand(5, "a", 20, "worse"), _cand(0, "b", 50, "tie, earlier")]]
    for rows in all_rows[:2]:
        _land(spark, f"{base}/in", rows)
    _best(spark, base)
    _land(spark, f"{base}/in", all_rows[2])
    table = _best(spark, base)  # a restart goes on from the checkpoint and the newest version
    rows = [r for part in all_rows for r in part]
    batch = D.url_dedup_best(spark.createDataFrame(rows, CAND)).collect()
    got = table.read().collect()
    assert sorted((r.url, r.title, r.pos, r.first_pos) for r in got) == sorted((r.url, r.title, r.pos, r.first_pos) for r in batch)
    assert {r.url: r.title for r in got} == {"a": "better", "b": "tie, earlier", "c": "c"}


def test_entries_past_their_time_leave_the_best_table(spark):
    from gleaner.streaming.runtime import scratch_dir

    base = scratch_dir(spark, "test-ttl")
    _land(spark, f"{base}/in", [_cand(1, "a", 90, "old", "2024-01-01T00:00:00+00:00"), _cand(2, "a", 10, "new", "2024-01-30T00:00:00+00:00"), _cand(3, "u", 1, "undated")])
    _land(spark, f"{base}/in", [_cand(4, "a", 20, "newer", "2024-01-31T00:00:00+00:00")])
    table = _best(spark, base, since=F.lit("2024-01-17"))
    assert {r.url: r.title for r in table.read().collect()} == {"a": "newer", "u": "undated"}


def test_url_best_stream_equals_batch(spark):
    from gleaner.plans.discovery_queries import q_url_dedup_best

    keys = ["url", "first_pos", "pos", "source", "discovery_score"]
    got = SQ.q_stream_url_best(spark, SF0001).select(keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, q_url_dedup_best(spark, SF0001).select(keys).collect()))


def test_an_update_writes_only_its_buckets(spark, tmp_path):
    from gleaner.streaming.buckets import BucketedTable

    table = BucketedTable(spark, str(tmp_path / "t"), "url", buckets=16, keep=2)
    table.create(spark.range(1000).selectExpr("concat('u', id) AS url", "id AS v"))
    newest = lambda old, new: old.join(new, "url", "left_anti").unionByName(new)
    folders = table.manifest()["folders"]
    assert table.update(spark.createDataFrame([("u7", -7), ("new", 1)], "url string, v long"), newest, "m1") == 1
    moved = {b for b, f in table.manifest()["folders"].items() if folders[b] != f}
    assert 1 <= len(moved) <= 2 and set(table.manifest()["folders"]) == set(folders)
    assert table.read().count() == 1001 and table.read().where("url = 'u7'").collect()[0].v == -7
    assert table.read(version=0).where("url = 'u7'").collect()[0].v == 7  # an earlier version stays readable
    # a retried batch changes nothing, an empty one neither
    assert table.update(spark.createDataFrame([("u7", 0)], "url string, v long"), newest, "m1") == 1
    assert table.update(spark.createDataFrame([], "url string, v long"), newest, "m2") == 1
    # what a failed update left goes with the next one, old versions too
    spark.range(1).selectExpr("'x' AS url", "id AS v").write.parquet(str(tmp_path / "t/data/v=2-dead/_bucket=0"))
    for k in range(2, 5):
        assert table.update(spark.createDataFrame([("u7", k)], "url string, v long"), newest, f"m{k}x") == k
    assert table.versions() == [3, 4] and table.read().where("url = 'u7'").collect()[0].v == 4
    left = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert "v=2-dead" not in left and len(left) <= 4 and table.read().count() == 1001


def test_seen_buckets_equal_the_seen_snapshot(spark):
    got = sorted(map(tuple, SQ.q_stream_seen_buckets(spark, SF0001).collect()), key=repr)
    assert got == sorted(map(tuple, SQ.q_stream_seen_upsert(spark, SF0001).collect()), key=repr)


def test_days_are_appended_once_when_they_close(spark):
    from gleaner.streaming import jobs as J
    from gleaner.streaming.runtime import run_available, scratch_dir

    base = scratch_dir(spark, "test-days")

    def run(rows):
        spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp_ntz) ts", "event_type").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(f"{base}/in")
        run_available(J.closed_days(J.stream_daily_volume(stream), f"{base}/out", f"{base}/_checkpoint"))
        return sorted(tuple(r) for r in spark.read.schema("event_type string, n long, day string").parquet(f"{base}/out").select("day", "event_type", "n").collect())

    assert run([("2024-01-01 01:00:00", "x"), ("2024-01-02 00:30:00", "x"), ("2024-01-03 02:00:00", "y")]) == [("2024-01-01", "x", 1)]
    # a late row of an open day counts, one of a closed day does not; closed days stay as they are
    assert run([("2024-01-02 05:00:00", "x"), ("2024-01-01 09:00:00", "x"), ("2024-01-04 12:00:00", "y")]) == [("2024-01-01", "x", 1), ("2024-01-02", "x", 2)]


def test_landed_files_grow_with_the_input(spark, tmp_path):
    """Four micro-batches, and no landing task with a quarter of a table of many splits."""
    path = str(tmp_path / "documents.parquet")
    spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text").repartition(6).write.option("maxRecordsPerFile", 30).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        landed, files = SQ.replay_documents(spark, str(tmp_path))
        splits = spark.read.parquet(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = [r["n"] for r in spark.read.parquet(landed).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert splits > 4 and files == splits and sum(rows) == 400 and max(rows) < 100
    assert len(rows) <= 4 * files
