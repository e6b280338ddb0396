"""State kept across runs: seen urls, recent topics, topic rotation, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import constants as C
from gleaner.functions.urls import normalize_url
from gleaner.operators.partitioning import BROADCAST_ROWS
from gleaner.session import ensure_checkpoint_dir

SEEN_FIELDS = ["title", "source", "published"]


def seen_upsert(seen: DataFrame, selected: DataFrame, now: Column, order_col: str = "rank") -> DataFrame:
    """Merge selected articles into the seen-url state.

    url is normalised again; first_seen is set once; last_seen, title, source and
    published are overwritten (also by empty strings); extra fields of existing
    records survive; within one batch the last article of a url wins.

    A batch is usually a top-k selection. It is counted: a small one is broadcast (the
    ever-growing seen table is then streamed and never shuffled), a large one goes
    through a full outer join on url.
    """
    batch = selected.select(
        normalize_url(F.col("url")).alias("url"),
        F.col(order_col).alias("_order"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SEEN_FIELDS],
    )
    last = batch.groupBy("url").agg(F.max_by(F.struct(*SEEN_FIELDS), F.col("_order")).alias("b"))
    extra = [c for c in seen.columns if c not in ("url", "first_seen", "last_seen", *SEEN_FIELDS)]
    # read by two joins: materialised once in the shared checkpoint folder
    ensure_checkpoint_dir(last.sparkSession)
    last = last.checkpoint(eager=True)
    if last.count() > BROADCAST_ROWS:
        s = seen.alias("s")
        j = s.join(last.alias("n"), F.col("s.url") == F.col("n.url"), "full_outer")
        hit = F.col("n.url").isNotNull()
        return j.select(
            F.coalesce(F.col("s.url"), F.col("n.url")).alias("url"),
            F.coalesce(F.col("s.first_seen"), now).alias("first_seen"),
            F.when(hit, now).otherwise(F.col("s.last_seen")).alias("last_seen"),
            *[F.when(hit, F.col(f"n.b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in SEEN_FIELDS],
            *[F.col(f"s.{c}") for c in extra],
        )
    small = F.broadcast(last.select("url", "b"))
    old = seen.join(small, "url", "left")
    hit = F.col("b").isNotNull()
    updated = old.select(
        "url",
        F.col("first_seen"),
        F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"),
        *[F.when(hit, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in SEEN_FIELDS],
        *[F.col(c) for c in extra],
    )
    known = seen.select("url").join(small.select("url"), "url", "left_semi")
    fresh = last.join(F.broadcast(known), "url", "left_anti").select(
        "url", now.alias("first_seen"), now.alias("last_seen"), *[F.col(f"b.{c}").alias(c) for c in SEEN_FIELDS],
        *[F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in extra],
    )
    return updated.unionByName(fresh)


def recent_tail(history: DataFrame, reader: str, order_cols: list[Column], n: int = C.RECENT_LIMIT) -> DataFrame:
    """Last ``n`` entries per reader (``n = 0`` keeps everything).

    ``row_number() <= n`` becomes a map-side group limit, so a reader holding a
    third of all rows still ships only ``n`` rows per task."""
    if n <= 0:
        return history.withColumn("recent_rank", F.lit(None).cast("int"))
    w = Window.partitionBy(reader).orderBy(*[c.desc() for c in order_cols])
    return history.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)


def topic_preference(topic: Column, seed: str) -> Column:
    """Deterministic stand-in for a random choice: md5 of topic and seed."""
    return F.md5(F.concat(topic, F.lit(seed)))


def topic_rotation(topics: DataFrame, recent: DataFrame, reader: str, n_recent: int, seed: str = "", readers: DataFrame | None = None) -> DataFrame:
    """One topic per reader: the first topic (in seeded hash order) the reader has
    not used recently; when every topic was used, the first topic overall.

    Exact without pairing every reader with every topic: if no reader has used more
    than m distinct topics, the answer is among the first m + 1 topics of the hash
    order. m is ``n_recent``, or counted when the whole history is recent
    (``n_recent = 0``). Those topics form an array that every reader filters.
    ``readers`` adds readers without history."""
    ordered = topics.distinct().select(F.col("topic"), topic_preference(F.col("topic"), seed).alias("h"))
    used_topics = recent.select(reader, "topic").distinct()
    most = n_recent if n_recent > 0 else used_topics.groupBy(reader).count().agg(F.max("count")).first()[0] or 0
    head = ordered.orderBy("h", "topic").limit(most + 1)
    head_arr = head.select(F.sort_array(F.collect_list(F.struct("h", "topic"))).alias("a")).select(
        F.transform("a", lambda x: x["topic"]).alias("a")).scalar()
    used = used_topics.groupBy(reader).agg(F.collect_set("topic").alias("used"))
    if readers is not None:
        used = readers.select(reader).distinct().join(used, reader, "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    used = used.withColumn("head", head_arr)
    unused = F.filter(F.col("head"), lambda t: ~F.array_contains(F.col("used"), t))
    pick = F.coalesce(F.try_element_at(unused, F.lit(1)), F.try_element_at(F.col("head"), F.lit(1)))
    return used.select(reader, pick.alias("topic"))


ENVELOPE_FIELDS = ["title", "url", "content", "source", "source_type", "published", "tags", "discovery_score"]


def envelope_build(selected: DataFrame, topic: str = "topic", source_mode: str | None = "feeds") -> DataFrame:
    """One envelope row per topic: {topic, source_mode, articles[]} as JSON.

    ``selected`` is a top-k result, so each topic's article list is bounded by k."""
    fields = [c for c in ENVELOPE_FIELDS if c in selected.columns]
    art = F.struct(F.col("rank"), F.struct(*fields).alias("a"))
    g = selected.groupBy(topic).agg(F.sort_array(F.collect_list(art)).alias("arts"))
    articles = F.transform("arts", lambda x: x["a"])
    env = [F.col(topic).alias("topic")]
    if source_mode is not None:
        env.append(F.lit(source_mode).alias("source_mode"))
    env.append(articles.alias("articles"))
    return g.select(F.col(topic).alias("topic"), F.size(articles).alias("n_articles"), F.to_json(F.struct(*env)).alias("envelope"))


ENVELOPE_SCHEMA = (
    "topic string, source_mode string, articles array<struct<title:string,url:string,content:string,source:string,"
    "source_type:string,published:string,tags:array<string>,discovery_score:int>>"
)


def envelope_explode(envelopes: DataFrame, col: str = "envelope") -> DataFrame:
    """Envelope JSON -> one row per article, with its position (stable later sorts)."""
    e = envelopes.select(F.from_json(F.col(col), ENVELOPE_SCHEMA).alias("e"))
    x = e.select("e.topic", "e.source_mode", F.posexplode_outer("e.articles").alias("pos", "a")).where(F.col("pos").isNotNull())
    return x.select("topic", "source_mode", F.col("pos").cast("int").alias("pos"), "a.*")


def candidate_union(feed_candidates: DataFrame, search_candidates: DataFrame) -> DataFrame:
    """Feed and search candidates in one table (search rows lack the feed-only fields)."""
    return feed_candidates.unionByName(search_candidates, allowMissingColumns=True)
