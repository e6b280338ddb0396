"""Seen-state merge against a dict model; recent tail; topic rotation."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from gleaner.operators import state as S


def test_seen_upsert_dict_model(spark):
    seen = spark.createDataFrame(
        [("https://a.org/x", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "old", "s", "p", "keep-me")],
        "url string, first_seen timestamp_ntz, last_seen timestamp_ntz, title string, source string, published string, extra string",
    )
    sel = spark.createDataFrame(
        [(1, "HTTPS://A.org/x/?utm_source=z", "new", "", ""), (2, "https://b.org/y", "b1", "s2", "p2"), (3, "https://b.org/y#f", "b2", "s3", "p3")],
        "rank int, url string, title string, source string, published string",
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    got = {r["url"]: r.asDict() for r in S.seen_upsert(seen, sel, now).collect()}
    assert got["https://a.org/x"]["first_seen"] == dt.datetime(2024, 1, 1)
    assert got["https://a.org/x"]["last_seen"] == dt.datetime(2024, 2, 1)
    assert (got["https://a.org/x"]["title"], got["https://a.org/x"]["source"]) == ("new", "")
    assert got["https://a.org/x"]["extra"] == "keep-me"
    assert got["https://b.org/y"]["title"] == "b2" and got["https://b.org/y"]["first_seen"] == dt.datetime(2024, 2, 1)
    # re-applying the same batch changes only last_seen
    again = {r["url"]: r.asDict() for r in S.seen_upsert(S.seen_upsert(seen, sel, now), sel, F.lit("2024-03-01").cast("timestamp_ntz")).collect()}
    for u, rec in got.items():
        assert {k: v for k, v in again[u].items() if k != "last_seen"} == {k: v for k, v in rec.items() if k != "last_seen"}


def test_recent_tail_and_rotation(spark):
    hist = [("r1", i, t) for i, t in enumerate(["a", "b", "c", "d", "e", "f", "a"])] + [("r2", 0, "z")]
    df = spark.createDataFrame(hist, "reader string, ts int, topic string")
    tail = S.recent_tail(df, "reader", [F.col("ts")], 3).collect()
    assert sorted((r["reader"], r["topic"]) for r in tail) == sorted([("r1", "a"), ("r1", "f"), ("r1", "e"), ("r2", "z")])
    assert S.recent_tail(df, "reader", [F.col("ts")], 0).count() == len(hist)
    topics = spark.createDataFrame([(t,) for t in ["a", "b", "c", "d", "e", "f", "a"]], "topic string")
    recent = S.recent_tail(df, "reader", [F.col("ts")], 3)
    got = {r["reader"]: r["topic"] for r in S.topic_rotation(topics, recent, "reader", 3, "seed").collect()}
    order = sorted(set("abcdef"), key=lambda t: (hashlib.md5((t + "seed").encode()).hexdigest(), t))
    assert got["r1"] == next(t for t in order if t not in {"a", "f", "e"})
    assert got["r2"] == order[0]


def test_rotation_without_a_recent_limit_and_without_history(spark):
    topics = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "topic string")
    recent = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r1", "c"), ("r2", "d"), ("r3", "a"), ("r3", "b"), ("r3", "c"), ("r3", "d")], "reader string, topic string")
    readers = spark.createDataFrame([("r1",), ("r4",)], "reader string")
    got = {r.reader: r.topic for r in S.topic_rotation(topics, recent, "reader", 0, seed="2024-01-31").collect()}
    assert got["r1"] == "d" and got["r2"] in ("a", "b", "c") and got["r3"] in ("a", "b", "c", "d")
    named = {r.reader: r.topic for r in S.topic_rotation(topics, recent, "reader", 0, seed="2024-01-31", readers=readers).collect()}
    assert set(named) == {"r1", "r4"} and named["r1"] == "d"
