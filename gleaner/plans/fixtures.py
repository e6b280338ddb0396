"""Derived input views over the driver tables (FIXTURES.md section 3).

Every view is a lazy DataFrame over ``{sf_dir}/<table>.parquet`` so its size grows
with the tables. Lookups by computed key (``doc_id % count(pages)``) are equi-joins
against a scalar subquery — no cross join — and let AQE choose broadcast or
shuffle from the measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.urls import normalize_url
from gleaner.operators.partitioning import spread

AS_OF = "2024-01-31 00:00:00"
DAYS = 14
CAP = 2
LIMIT = 6
BACKFILL_CAP = 1
BACKFILL_LIMIT = 30
TOPIC = "AI agents for data and devops"
SEEN_FIRST = "2024-01-01 00:00:00"
SEEN_LAST = "2024-01-10 00:00:00"

FEED_WEIGHTS = [0.5, 0.7, 0.8, 0.9, 0.29]
FEED_TAGS = [["ai", "llm"], ["devops", "cloud"], ["data"], []]


def as_of_col(as_of: str = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count_scalar(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed dimension: one row per distinct document source.

    The numbering window runs over the *distinct* sources (the feed list), not
    over documents, so its single partition holds one row per feed.
    """
    src = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    i = F.row_number().over(Window.orderBy("name")) - 1
    weights = F.array(*[F.lit(w).cast("double") for w in FEED_WEIGHTS])
    tags = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<string>") for ts in FEED_TAGS])
    return (
        src.withColumn("i", i)
        .select(
            "name",
            F.element_at(weights, (F.col("i") % len(FEED_WEIGHTS) + 1).cast("int")).alias("weight"),
            F.element_at(tags, (F.col("i") % len(FEED_TAGS) + 1).cast("int")).alias("tags"),
        )
    )


def two_feeds_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed list with two feeds of each name: an even id (RSS) and the odd one after it (Atom),
    which has the weight and tags of the next places in their lists."""
    src = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    numbered = src.withColumn("i", F.row_number().over(Window.orderBy("name")) - 1)
    both = numbered.select("name", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
    weights = F.array(*[F.lit(w).cast("double") for w in FEED_WEIGHTS])
    tags = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<string>") for ts in FEED_TAGS])
    at = F.col("i") + F.col("odd")
    return both.select(
        (2 * F.col("i") + F.col("odd")).cast("long").alias("feed_id"), "name",
        F.element_at(weights, (at % len(FEED_WEIGHTS) + 1).cast("int")).alias("weight"),
        F.element_at(tags, (at % len(FEED_TAGS) + 1).cast("int")).alias("tags"),
    )


def land_feeds(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write every entry as feed documents ``folder/feed_id=<id>/*.xml`` and return the feed list.

    Even documents go to their source's RSS feed, odd ones to its Atom feed. Files follow
    each other by (feed, pos); a hot feed is spread over several."""
    feeds_ = two_feeds_per_name(spark, sf_dir)
    ids = feeds_.select("feed_id", F.col("name").alias("source"), (F.col("feed_id") % 2).alias("odd"))
    e = entries(spark, sf_dir).withColumn("odd", F.col("pos") % 2).join(ids, ["source", "odd"])
    rfc = lambda c: F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = e.where("odd = 0").select(
        "feed_id", "pos", "title", "link", F.col("summary").alias("description"), F.col("terms").alias("category"),
        rfc(F.coalesce("published", "updated")).alias("pubDate"),
    )
    atom = e.where("odd = 1").select(
        "feed_id", "pos", "title", F.array(F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel"))).alias("link"), "summary",
        F.transform("terms", lambda t: F.struct(t.alias("_term"))).alias("category"), iso("published").alias("published"), iso("updated").alias("updated"),
    )
    for df, root, row in ((rss, "channel", "item"), (atom, "feed", "entry")):
        ordered = df.repartitionByRange("feed_id", "pos").sortWithinPartitions("feed_id", "pos").drop("pos")
        ordered.write.format("xml").option("rootTag", root).option("rowTag", row).partitionBy("feed_id").mode("append").save(folder)
    return feeds_


def _second(ts: Column) -> Column:
    """Feed dates have whole-second resolution (field arithmetic: no time zone involved)."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.floor(F.second(ts)))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries derived from documents (pos = doc_id = arrival order)."""
    return entries_from(table(spark, sf_dir, "documents"), spark, sf_dir)


def entries_from(documents: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for a documents DataFrame (batch or stream; lookups are static tables)."""
    docs = spread(documents.select("doc_id", "source", "lang", "text"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    keyed = docs.select(
        "*",
        (F.col("doc_id") % _count_scalar(pages)).alias("page_key"),
        ((F.col("doc_id") * 7919) % _count_scalar(events)).alias("event_key"),
    )
    joined = keyed.join(pages, keyed.page_key == pages.page_id, "left").join(events, keyed.event_key == events.event_id, "left")
    ts = _second(F.col("ts"))
    return joined.select(
        F.col("doc_id").alias("pos"),
        "source",
        F.when(F.col("doc_id") % 50 == 49, F.lit("")).otherwise(F.col("url")).alias("link"),
        F.concat_ws(" ", "source", F.lit("entry"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("summary"),
        F.array("lang").alias("terms"),
        F.when(F.col("doc_id") % 11 == 10, F.lit(None).cast("timestamp_ntz")).otherwise(ts).alias("published"),
        F.when(F.col("doc_id") % 22 == 10, ts).otherwise(F.lit(None).cast("timestamp_ntz")).alias("updated"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen state: normalised page urls with page_id % 5 = 0."""
    pages = table(spark, sf_dir, "pages")
    return pages.where(F.col("page_id") % 5 == 0).select(
        normalize_url("url").alias("url"),
        F.lit(SEEN_FIRST).cast("timestamp_ntz").alias("first_seen"),
        F.lit(SEEN_LAST).cast("timestamp_ntz").alias("last_seen"),
        F.lit("").alias("title"),
        F.lit("").alias("source"),
        F.lit("").alias("published"),
    )


def pages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed crawl table: pages plus content type and fetch outcome (FIXTURES.md)."""
    pages = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    ct = (
        F.when(pid % 17 == 0, F.lit("application/pdf"))
        .when(pid % 19 == 0, F.lit(""))
        .otherwise(F.lit("text/html; charset=utf-8"))
    )
    failed = (
        F.when(pid % 23 == 0, F.array(F.lit("timeout"), F.lit("")))
        .when(pid % 29 == 0, F.array(F.lit("http-error"), F.lit("HTTP 404: Not Found")))
        .when(pid % 31 == 0, F.array(F.lit("url-error"), F.lit("Name or service not known")))
        .when(pid % 37 == 0, F.array(F.lit("fetch-error"), F.lit("connection reset")))
        .otherwise(F.array(F.lit("ok"), F.lit("")))
    )
    url = F.when(pid % 41 == 0, F.concat(F.lit("ftp"), F.substring("url", F.instr("url", ":"), F.length("url")))).otherwise(F.col("url"))
    return spread(pages.select("page_id", url.alias("url"), "html", ct.alias("content_type"), failed[0].alias("fetch_status"), failed[1].alias("fetch_error")), heavy="html")
