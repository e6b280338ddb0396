"""Feed discovery: enrich, filter, score, deduplicate per url, rank, capped top-k.

Plan shape of ``capped_topk`` (the flagship): scan -> filter -> anti-join seen ->
score (narrow) -> partial aggregate per url (map side) -> shuffle(url) -> final
aggregate -> partial per-source group limit (map side) -> shuffle(source) ->
window -> TakeOrderedAndProject(k). Both shuffles carry pre-reduced rows, so a
hot url or a hot source never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import constants as C
from gleaner.functions.scoring import haystack, iso_utc, recency_bonus, topic_score, weight_bonus
from gleaner.functions.text import py_strip
from gleaner.functions.urls import normalize_url
from gleaner.operators.partitioning import BROADCAST_ROWS
from gleaner.operators.ranking import row_number_within

PAYLOAD = ["title", "content", "source_type", "published", "tags"]


def enrich_with_feeds(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach each entry's feed tags and weight (equi-join on the feed name).

    Feeds that share a name count as one, the heaviest, so no entry is doubled;
    entries of an unlisted or unnamed feed stay without tags and weight."""
    f = feeds.groupBy(F.col("name").alias("source")).agg(F.max_by(F.struct("tags", "weight"), F.col("weight")).alias("_f"))
    f = f.select("source", F.col("_f.tags").alias("feed_tags"), F.col("_f.weight").alias("feed_weight"))
    return entries.join(f, "source", "left")


def enrich_landed(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach name (as ``source``), tags and weight to landed entries by feed id.

    Feeds of one name stay apart. ``feeds`` holds one row per feed id; entries of an
    unlisted feed keep nulls."""
    f = feeds.select("feed_id", F.col("name").alias("source"), F.col("tags").alias("feed_tags"), F.col("weight").alias("feed_weight"))
    return entries.join(f, "feed_id", "left")


def entry_published(entries: DataFrame) -> Column:
    """published, else updated, else null."""
    return F.coalesce(F.col("published"), F.col("updated"))


def entry_text(title, summary, terms) -> Column:
    """Title, summary and tag terms, empty parts skipped, joined by newlines."""
    parts = F.concat(F.array(F.col(title) if isinstance(title, str) else title, F.col(summary) if isinstance(summary, str) else summary),
                     F.coalesce(F.col(terms) if isinstance(terms, str) else terms, F.array().cast("array<string>")))
    # array_remove + array_join (which skips nulls) instead of a lambda filter: no
    # higher-order function, so the expression stays codegen'd and shareable
    return F.array_join(F.array_remove(parts, ""), "\n")


def with_urls(entries: DataFrame) -> DataFrame:
    """Drop entries without a link and add the normalised url."""
    return entries.where(F.col("link").isNotNull() & (F.col("link") != "")).withColumn("url", normalize_url("link"))


def suppress_seen(entries: DataFrame, seen: DataFrame | None, include_seen: bool = False) -> DataFrame:
    """Left-anti join on url; AQE broadcasts the seen side only when it is measured small."""
    if include_seen or seen is None:
        return entries
    return entries.join(seen.select("url"), "url", "left_anti")


def recency_filter(entries: DataFrame, as_of: Column, days: int = C.DEFAULT_DAYS, published: str = "published") -> DataFrame:
    """Keep undated entries and those published at or after as_of - days."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return entries.where(F.col(published).isNull() | (F.col(published) >= cutoff))


def with_haystack(entries: DataFrame) -> DataFrame:
    """The lower-cased text every keyword test reads, computed once per entry."""
    return entries.withColumn("_hay", haystack(entry_text("title", "summary", "terms"), F.col("feed_tags")))


def discovery_score(topic: str, as_of: Column) -> Column:
    """Needs ``_hay`` (``with_haystack``) on the input."""
    return topic_score(topic, F.col("_hay")) + weight_bonus(F.col("feed_weight")) + recency_bonus(F.col("published"), as_of)


def candidates(
    entries: DataFrame,
    feeds: DataFrame,
    topic: str | list[str],
    as_of: Column,
    days: int = C.DEFAULT_DAYS,
    seen: DataFrame | None = None,
    include_seen: bool = False,
    enrich=enrich_with_feeds,
) -> DataFrame:
    """Scored candidate rows (one per surviving entry), in the candidate schema plus pos.

    With a list of topics every entry is scored for each topic in one pass (a
    generator over per-topic score structs, not a join) and rows carry ``topic``;
    group the later steps by it (``group_cols=["topic"]``). Landed entries take
    ``enrich=enrich_landed``."""
    e = with_urls(entries)
    e = suppress_seen(e, seen, include_seen)
    e = e.withColumn("published", entry_published(e))
    e = recency_filter(e, as_of, days)
    e = with_haystack(enrich(e, feeds))
    many = isinstance(topic, (list, tuple))
    scored = (
        F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), discovery_score(t, as_of).alias("s")) for t in topic]))
        if many else None
    )
    base = e.select("*", scored.alias("_ts")) if many else e
    score = F.col("_ts.s") if many else discovery_score(topic, as_of)
    return base.select(
        *([F.col("_ts.topic").alias("topic")] if many else []),
        "pos",
        "url",
        py_strip(F.coalesce(F.col("title"), F.col("url"))).alias("title"),
        py_strip(F.coalesce(F.col("summary"), F.lit(""))).alias("content"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        F.lit("feed").alias("source_type"),
        iso_utc("published").alias("published"),
        F.coalesce(F.col("feed_tags"), F.array().cast("array<string>")).alias("tags"),
        score.alias("discovery_score"),
    )


def url_dedup_best(cands: DataFrame, group_cols: list[str] | None = None, payload: list[str] = PAYLOAD) -> DataFrame:
    """Best-scoring row per url (tie: first arrival) plus the url's first-arrival position.

    One aggregate: partial per map task, so a url repeated in a third of all rows
    still ships one row per task. ``payload`` columns travel through the shuffle: a
    top-k leaves them out and joins them back (``best_topk``).
    """
    best = F.max(F.struct(F.col("discovery_score"), (-F.col("pos")).alias("neg_pos"), *[F.col(c) for c in ["pos", "source", *payload]]))
    keys = [*(group_cols or []), "url"]
    agg = cands.groupBy(*keys).agg(best.alias("b"), F.min("pos").alias("first_pos"))
    return agg.select(*keys, "first_pos", *[F.col("b")[c].alias(c) for c in ["pos", "source", *payload, "discovery_score"]])


def rank_order() -> list[Column]:
    return [F.col("discovery_score").desc(), F.col("first_pos").asc(), F.col("url").asc()]


def rank_within_source(best: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Exact rank of every url inside its (topic,) source by (score desc, first arrival)."""
    return row_number_within(best, [*(group_cols or []), "source"], rank_order(), name="rn_in_source")


def capped_topk(best: DataFrame, cap: int = C.MAX_PER_SOURCE, limit: int = C.DEFAULT_LIMIT, group_cols: list[str] | None = None) -> DataFrame:
    """At most ``cap`` per source by rank, backfilled by rank up to ``limit`` rows.

    Equals the first ``limit`` rows of the order (rn_in_source > cap, score desc,
    first arrival). Only the first ``k`` rows of a source can reach a top-k, so the
    per-source rank is filtered ``<= k`` first, which Spark turns into a map-side
    group limit. A limit of 0 or less still yields one row (the reference checks
    the size after appending).
    """
    groups = group_cols or []
    k = max(limit, 1)
    w = Window.partitionBy(*groups, "source").orderBy(*rank_order())
    ranked = best.withColumn("rn_in_source", F.row_number().over(w)).where(F.col("rn_in_source") <= k)
    order = [(F.col("rn_in_source") > F.lit(cap)).asc(), *rank_order()]
    if not groups:
        top = ranked.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    wt = Window.partitionBy(*groups).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(wt)).where(F.col("rank") <= k)


def best_topk(cands: DataFrame, cap: int = C.MAX_PER_SOURCE, limit: int = C.DEFAULT_LIMIT, group_cols: list[str] | None = None) -> DataFrame:
    """Url dedup and capped top-k on keys and scores only; the payload of the chosen rows is joined back.

    Texts never enter a dedup or ranking shuffle. Without groups the chosen rows are
    at most ``limit`` and are broadcast to the candidates; with groups AQE decides.

    A chosen row is found again by all its keys (topic, url, pos, source, score), nulls
    included. Rows that agree in all of them are one candidate, the one with the smallest
    payload (a group limit of one per rank and task before the shuffle), so every rank
    comes out exactly once.
    """
    groups = group_cols or []
    keys = [*groups, "url", "pos", "source", "discovery_score"]
    top = capped_topk(url_dedup_best(cands.select(*keys), groups, payload=[]), cap=cap, limit=limit, group_cols=groups)
    top = top.select(*[F.col(k).alias(f"_{k}") for k in keys], "first_pos", "rn_in_source", "rank")
    chosen = F.broadcast(top) if not groups and max(limit, 1) <= BROADCAST_ROWS else top
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    found = cands.select(*keys, *PAYLOAD).join(chosen, same)
    w = Window.partitionBy(*groups, "rank").orderBy(*PAYLOAD)
    one = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    return one.select(*groups, "pos", *PAYLOAD, "url", "first_pos", "source", "discovery_score", "rn_in_source", "rank")
