"""Registered state, envelope, union and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import discovery as D
from gleaner.operators import state as S
from gleaner.plans import fixtures as X
from gleaner.plans.analysis_queries import q_response_array_explode
from gleaner.plans.discovery_queries import _candidates
from gleaner.sources import feeds as FS

N_RECENT = 5
SEED = "2024-01-31"
TS = "yyyy-MM-dd HH:mm:ss"


def _history(spark, sf_dir) -> DataFrame:
    """Reading history per reader: events (user_id, ts, event_id) with event_type as topic."""
    e = X.table(spark, sf_dir, "events")
    return e.select(F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("topic"))


def q_recent_tail(spark, sf_dir):
    r = S.recent_tail(_history(spark, sf_dir), "user_id", [F.col("ts"), F.col("event_id")], N_RECENT)
    return r.select("user_id", "event_id", "topic", F.col("recent_rank").cast("int").alias("recent_rank"))


def q_topic_rotation(spark, sf_dir):
    h = _history(spark, sf_dir)
    recent = S.recent_tail(h, "user_id", [F.col("ts"), F.col("event_id")], N_RECENT)
    topics = h.select("topic").distinct()
    return S.topic_rotation(topics, recent, "user_id", N_RECENT, SEED)


def _selected(spark, sf_dir, include_seen: bool, cap: int, limit: int):
    c = D.candidates(X.entries(spark, sf_dir), X.feeds(spark, sf_dir), X.TOPIC, X.as_of_col(), X.DAYS,
                     seen=X.seen(spark, sf_dir), include_seen=include_seen)
    return D.best_topk(c, cap=cap, limit=limit)


def q_seen_upsert(spark, sf_dir):
    sel = _selected(spark, sf_dir, True, X.BACKFILL_CAP, X.BACKFILL_LIMIT)
    merged = S.seen_upsert(X.seen(spark, sf_dir), sel, X.as_of_col())
    return merged.select("url", F.date_format("first_seen", TS).alias("first_seen"), F.date_format("last_seen", TS).alias("last_seen"),
                         "title", "source", "published")


def _envelopes(spark, sf_dir):
    sel = _selected(spark, sf_dir, False, X.CAP, X.LIMIT).withColumn("topic", F.lit(X.TOPIC))
    return S.envelope_build(sel)


def q_envelope_build(spark, sf_dir):
    return _envelopes(spark, sf_dir)


def q_envelope_explode(spark, sf_dir):
    x = S.envelope_explode(_envelopes(spark, sf_dir))
    return x.select("topic", "source_mode", "pos", "url", "title", "discovery_score")


def q_candidate_union(spark, sf_dir):
    feed = _candidates(spark, sf_dir).select("url", "title", "content", "source", "source_type", "discovery_score")
    search = q_response_array_explode(spark, sf_dir).where("ok").select("url", "title", "content")
    u = S.candidate_union(feed.withColumn("mode", F.lit("feeds")), search.withColumn("mode", F.lit("search")))
    return u.select("mode", "url", "title", "source", "source_type", "discovery_score")


def q_seen_state_scan(spark, sf_dir):
    """Seen records as JSON map documents ({url: {...}}), parsed back into rows."""
    s = X.seen(spark, sf_dir)
    rec = F.struct(F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("first_seen"),
                   F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_seen"), "title", "source", "published")
    docs = s.select(F.to_json(F.create_map(F.col("url"), rec)).alias("value"))
    return FS.parse_seen_map(docs).select("url", "first_seen", "last_seen", "title")


def _xml_text(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def q_feed_entry_scan(spark, sf_dir):
    """Entries rendered as RSS <item> payloads, then scanned back with from_xml."""
    e = X.entries(spark, sf_dir)
    pub = F.coalesce(F.col("published"), F.col("updated"))
    item = F.concat(
        F.lit("<item><title>"), _xml_text(F.col("title")), F.lit("</title><link>"), _xml_text(F.col("link")),
        F.lit("</link><description><![CDATA["), F.col("summary"), F.lit("]]></description>"),
        F.concat_ws("", F.transform("terms", lambda t: F.concat(F.lit("<category>"), _xml_text(t), F.lit("</category>")))),
        F.when(pub.isNotNull(), F.concat(F.lit("<pubDate>"), F.date_format(pub, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")))
        .otherwise(F.lit("")),
        F.lit("</item>"),
    )
    parsed = FS.parse_rss_items(e.select("pos", "source", item.alias("xml")), "xml")
    return parsed.where(F.coalesce(F.col("link"), F.lit("")) != "").select(
        "pos", "source", "link", "title", F.length("summary").alias("summary_chars"), F.array_join("terms", ",").alias("terms"),
        F.date_format("published", TS).alias("published"))


QUERIES = {
    "recent_tail": q_recent_tail,
    "topic_rotation": q_topic_rotation,
    "seen_upsert": q_seen_upsert,
    "envelope_build": q_envelope_build,
    "envelope_explode": q_envelope_explode,
    "candidate_union": q_candidate_union,
    "seen_state_scan": q_seen_state_scan,
    "feed_entry_scan": q_feed_entry_scan,
}
