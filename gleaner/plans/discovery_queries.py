"""Registered discovery queries: (spark, sf_dir) -> DataFrame with scalar columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scoring import haystack, iso_utc, keyword_hits, recency_bonus, topic_score, topic_tokens, weight_bonus
from gleaner.functions.urls import normalize_url
from gleaner.operators import discovery as D
from gleaner.plans import fixtures as X
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources import feeds as FS


def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def q_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", normalize_url("url").alias("norm_url"))


def q_entry_published(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    return e.select("pos", iso_utc(D.entry_published(e)).alias("published"))


def q_recency_filter(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    e = e.withColumn("published", D.entry_published(e))
    return D.recency_filter(e, X.as_of_col(), X.DAYS).select("pos", _ts_text(F.col("published")).alias("published"))


def q_entry_text(spark, sf_dir):
    e = X.entries(spark, sf_dir)
    return e.select("pos", D.entry_text("title", "summary", "terms").alias("text"))


def q_topic_tokens(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    toks = topic_tokens("text")
    return docs.select("doc_id", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


def _enriched(spark, sf_dir):
    return D.enrich_with_feeds(X.entries(spark, sf_dir), X.feeds(spark, sf_dir))


def q_feed_entry_enrich(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("pos", "source", F.col("feed_weight").alias("weight"), F.array_join("feed_tags", ",").alias("tags"))


def q_keyword_hits(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    hay = haystack(D.entry_text("title", "summary", "terms"), F.col("feed_tags"))
    # explode_outer + null filter: a plain explode makes Spark add (and push down) a
    # size(array) > 0 filter that evaluates the keyword tests a second time
    hits = e.select("pos", F.explode_outer(keyword_hits(X.TOPIC, hay)).alias("h")).where(F.col("h").isNotNull())
    return hits.select("pos", F.col("h.category").alias("category"), F.col("h.keyword").alias("keyword"))


def q_topic_score(spark, sf_dir):
    e = D.with_haystack(_enriched(spark, sf_dir))
    return e.select("pos", topic_score(X.TOPIC, F.col("_hay")).alias("topic_score"))


def q_discovery_score(spark, sf_dir):
    e = D.with_urls(X.entries(spark, sf_dir))
    e = e.withColumn("published", D.entry_published(e))
    e = D.recency_filter(e, X.as_of_col(), X.DAYS)
    e = D.with_haystack(D.enrich_with_feeds(e, X.feeds(spark, sf_dir)))
    return e.select(
        "pos",
        "url",
        topic_score(X.TOPIC, F.col("_hay")).alias("topic_score"),
        weight_bonus(F.col("feed_weight")).alias("weight_bonus"),
        recency_bonus(F.col("published"), X.as_of_col()).alias("recency_bonus"),
        D.discovery_score(X.TOPIC, X.as_of_col()).alias("discovery_score"),
    )


def _candidates(spark, sf_dir):
    return D.candidates(
        X.entries(spark, sf_dir), X.feeds(spark, sf_dir), X.TOPIC, X.as_of_col(), X.DAYS, seen=X.seen(spark, sf_dir)
    )


def q_seen_suppress(spark, sf_dir):
    e = D.with_urls(X.entries(spark, sf_dir))
    return D.suppress_seen(e, X.seen(spark, sf_dir)).select("pos", "url")


def q_candidate_build(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("pos", "title", "url", "content", "source", "source_type", "published",
                    F.array_join("tags", ",").alias("tags"), "discovery_score")


def q_url_dedup_best(spark, sf_dir):
    best = D.url_dedup_best(_candidates(spark, sf_dir), payload=[])
    return best.select("url", "first_pos", "pos", "source", "discovery_score")


def q_rank_within_source(spark, sf_dir):
    best = D.url_dedup_best(_candidates(spark, sf_dir), payload=[])
    ranked = D.rank_within_source(best)
    return ranked.select("url", "source", "discovery_score", "first_pos", F.col("rn_in_source").cast("int").alias("rn_in_source"))


def _topk(spark, sf_dir, cap, limit):
    top = D.best_topk(_candidates(spark, sf_dir), cap=cap, limit=limit)
    return top.select(F.col("rank").cast("int").alias("rank"), "url", "title", "source", "published", "discovery_score")


def q_capped_topk(spark, sf_dir):
    return _topk(spark, sf_dir, X.CAP, X.LIMIT)


def q_capped_topk_backfill(spark, sf_dir):
    return _topk(spark, sf_dir, X.BACKFILL_CAP, X.BACKFILL_LIMIT)


TOPICS = [X.TOPIC, "Kubernetes operations", "security for AI systems"]


def q_capped_topk_topics(spark, sf_dir):
    """The flagship for several topics in one pass, capped and backfilled per topic."""
    cands = D.candidates(X.entries(spark, sf_dir), X.feeds(spark, sf_dir), TOPICS, X.as_of_col(), X.DAYS, seen=X.seen(spark, sf_dir))
    top = D.best_topk(cands, cap=X.BACKFILL_CAP, limit=X.BACKFILL_LIMIT, group_cols=["topic"])
    return top.select("topic", F.col("rank").cast("int").alias("rank"), "url", "title", "source", "published", "discovery_score")


def _landed(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark)}/landed-feeds-{uuid.uuid4().hex}"
    feeds = X.land_feeds(spark, sf_dir, folder)
    return FS.quarantine(FS.read_landed_feeds(spark, folder))[0], feeds


def q_landed_feeds(spark, sf_dir):
    """Feed documents on disk -> entries with their feed's own name, weight and tags."""
    entries, feeds = _landed(spark, sf_dir)
    e = D.enrich_landed(entries.where(F.coalesce(F.col("link"), F.lit("")) != ""), feeds)
    return e.select("feed_id", "entry_no", "kind", "source", "link", "title", F.length("summary").alias("summary_chars"),
                    F.array_join("terms", ",").alias("terms"), iso_utc(D.entry_published(e)).alias("published"),
                    F.col("feed_weight").alias("weight"), F.array_join("feed_tags", ",").alias("tags"))


def q_landed_feeds_topk(spark, sf_dir):
    """The capped, backfilled top-k straight from feed documents."""
    entries, feeds = _landed(spark, sf_dir)
    cands = D.candidates(entries, feeds, X.TOPIC, X.as_of_col(), X.DAYS, seen=X.seen(spark, sf_dir), enrich=D.enrich_landed)
    top = D.best_topk(cands, cap=X.BACKFILL_CAP, limit=X.BACKFILL_LIMIT)
    return top.select(F.col("rank").cast("int").alias("rank"), "url", "title", "source", "published", F.array_join("tags", ",").alias("tags"), "discovery_score")


QUERIES = {
    "landed_feeds": q_landed_feeds,
    "landed_feeds_topk": q_landed_feeds_topk,
    "normalize_url": q_normalize_url,
    "entry_published": q_entry_published,
    "recency_filter": q_recency_filter,
    "entry_text": q_entry_text,
    "topic_tokens": q_topic_tokens,
    "feed_entry_enrich": q_feed_entry_enrich,
    "keyword_hits": q_keyword_hits,
    "topic_score": q_topic_score,
    "discovery_score": q_discovery_score,
    "seen_suppress": q_seen_suppress,
    "candidate_build": q_candidate_build,
    "url_dedup_best": q_url_dedup_best,
    "rank_within_source": q_rank_within_source,
    "capped_topk": q_capped_topk,
    "capped_topk_backfill": q_capped_topk_backfill,
    "capped_topk_topics": q_capped_topk_topics,
}
