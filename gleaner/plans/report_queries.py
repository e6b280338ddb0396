"""Registered report queries over the derived ``analysed`` view (labels x documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.scoring import iso_utc
from gleaner.functions.model_output import MSG_MISSING, error_analysis
from gleaner.functions.text import slugify
from gleaner.operators import report as R
from gleaner.plans import fixtures as X

RECS = ["read", "skim", "watch", "ignore"]
GENERATED_AT = "2024-01-31T00:00:00"
MODEL = "local-model"
SEP = "||"


def analysed(spark: SparkSession, sf_dir: str, with_content: bool = False) -> DataFrame:
    """Triaged articles: one per document, topic = document language.

    A document without labels has no model judgement and carries the error record."""
    labels = X.table(spark, sf_dir, "labels")
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    pages = X.table(spark, sf_dir, "pages").select("page_id", "url")
    events = X.table(spark, sf_dir, "events").select("event_id", "ts")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    n_events = events.select(F.count(F.lit(1))).scalar()
    d = docs.join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left").select("*", (F.col("doc_id") % n_pages).alias("pk"), (F.col("doc_id") * 7919 % n_events).alias("ek"))
    d = d.join(pages, d.pk == pages.page_id, "left").join(events, d.ek == events.event_id, "left")
    i = F.col("doc_id")
    q = F.col("quality")
    rec = F.element_at(F.array(*[F.lit(r) for r in RECS]), ((i * 7 + q) % 4 + 1).cast("int"))
    analysis = F.struct(
        rec.alias("recommendation"),
        (i * 37 % 101).cast("int").alias("signal_score"),
        (i * 53 % 101).cast("int").alias("fluff_score"),
        (i * 11 % 101).cast("int").alias("technical_depth"),
        (i * 13 % 101).cast("int").alias("novelty"),
        (i * 17 % 101).cast("int").alias("relevance"),
        F.when(i % 9 == 0, F.lit("")).when(i % 9 == 1, F.lit("Not specified.")).otherwise(F.col("text")).alias("summary"),
        F.when(i % 7 == 0, F.lit("none called out.")).otherwise(F.concat(F.lit("Matches "), F.col("lang"))).alias("why_selected"),
        F.array(F.concat(F.lit("claim "), i.cast("string")), F.lit("Not specified.")).alias("technically_sound_claims"),
        F.when(F.col("toxic") == 1, F.array(F.concat(F.lit("hype "), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("marketing_or_hype"),
        F.array(F.lit("")).alias("claims_to_verify"),
        F.array(F.concat(F.lit("matters to "), F.col("lang"))).alias("why_it_matters_to_me"),
        F.when(F.col("toxic") == 1, F.lit("No skeptical take produced.")).otherwise(F.concat(F.lit("Check claims about "), F.col("source"))).alias("skeptical_take"),
        F.when(q == 0, F.lit("No action suggested.")).otherwise(F.lit("Read the source")).alias("suggested_action"),
        F.array(F.col("lang"), F.lit(""), F.lit("none called out."), F.col("source")).alias("tags"),
        F.when(i % 13 == 0, F.lit("Could not parse model JSON")).alias("analysis_error"),
    )
    analysis = F.when(F.col("labelled"), analysis).otherwise(error_analysis(F.lit(MSG_MISSING)))
    extraction = F.struct(
        F.concat(F.lit("site-"), F.col("lang")).alias("site_name"),
        F.concat(F.lit("2024-01-0"), (i % 9 + 1).cast("string")).alias("published_date"),
        F.when(q == 1, F.lit("ok")).otherwise(F.lit("too-short")).alias("status"),
        F.col("n_chars").cast("int").alias("content_chars"),
    )
    ts = X._second(F.col("ts"))
    return d.select(
        F.col("lang").alias("topic"),
        i.alias("pos"),
        F.concat_ws(" ", "source", F.lit("article"), i.cast("string")).alias("title"),
        F.col("url"),
        F.when(i % 6 == 0, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.when(i % 4 == 0, F.lit("")).otherwise(iso_utc(ts)).alias("published"),
        F.when(q == 1, F.lit(C.CONTENT_SOURCE_EXTRACTED)).otherwise(F.lit(C.CONTENT_SOURCE_FALLBACK)).alias("content_source"),
        extraction.alias("extraction"),
        analysis.alias("analysis"),
        *([F.col("text").alias("content"), F.array("lang").alias("tags"), F.lit("feed").alias("source_type")] if with_content else []),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select(F.col("lang").alias("topic")).distinct()


def q_meaningful_filter(spark, sf_dir):
    a = analysed(spark, sf_dir)
    x = F.col("analysis")
    tags = R.meaningful_items(x["tags"])
    return a.select(
        "pos",
        F.array_join(tags, SEP).alias("tags"),
        F.size(tags).alias("n_tags"),
        R.meaningful(x["summary"]).alias("summary_meaningful"),
        R.meaningful(x["why_selected"]).alias("why_meaningful"),
    )


def q_digest_rank(spark, sf_dir):
    r = R.digest_rank(analysed(spark, sf_dir))
    return r.select("topic", "pos", F.col("digest_rank").cast("int").alias("digest_rank"))


def q_recommendation_counts(spark, sf_dir):
    return R.recommendation_counts(analysed(spark, sf_dir), topics(spark, sf_dir))


def q_digest_sections(spark, sf_dir):
    s = R.with_sections(R.digest_rank(analysed(spark, sf_dir)))
    return s.select("topic", "pos", "section", F.col("section_rank").cast("int").alias("section_rank"))


def q_digest_topline(spark, sf_dir):
    t = R.topline(analysed(spark, sf_dir), topics(spark, sf_dir))
    return t.select("topic", "best_title", "counts_line")


def q_digest_cards(spark, sf_dir):
    c = R.card_fields(analysed(spark, sf_dir))
    return c.select(
        "topic", "pos", "badge", "card_title", "display_source", "display_published", "card_content_source", "card_status",
        "card_summary", "card_take", "card_action", "card_why", F.array_join("card_tags", SEP).alias("card_tags"), "card_error",
        *[F.array_join(f"card_{k}", SEP).alias(f"card_{k}") for k in C.LIST_FIELDS[:4]], "card_has_details",
    )


def q_digest_report(spark, sf_dir):
    return R.digest_lines(analysed(spark, sf_dir), topics(spark, sf_dir), GENERATED_AT, MODEL)


def q_manual_report(spark, sf_dir):
    a = analysed(spark, sf_dir).withColumn("title", F.col("url"))
    return R.manual_lines(a, "manual URL review", GENERATED_AT, MODEL)


def q_triage_summary(spark, sf_dir):
    return R.triage_summary(analysed(spark, sf_dir))


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis archive rows: run_date partition, one JSON document per article."""
    a = analysed(spark, sf_dir, with_content=True)
    run_date = F.coalesce(F.nullif(F.substring("published", 1, 10), F.lit("")), F.lit("2024-01-31"))
    article = F.to_json(F.struct("pos", "title", "url", "source", "published", "content_source", "content", "tags", "source_type", "extraction", "analysis"))
    return a.select("topic", run_date.alias("run_date"), F.lit(GENERATED_AT).alias("generated_at"), F.lit(MODEL).alias("model"),
                    "pos", article.alias("article"))


def q_analysis_archive(spark, sf_dir):
    r = archive_rows(spark, sf_dir)
    x = F.col("article")
    return r.select("topic", "run_date", "pos",
                    F.get_json_object(x, "$.analysis.recommendation").alias("recommendation"),
                    F.get_json_object(x, "$.title").alias("title"),
                    F.get_json_object(x, "$.extraction.status").alias("status"),
                    F.md5(F.get_json_object(x, "$.content")).alias("content_md5"))


def q_latest_snapshot(spark, sf_dir):
    """Latest archive per topic: max run_date and its size (two partial aggregates, no self-join)."""
    per_run = archive_rows(spark, sf_dir).groupBy("topic", "run_date").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("topic").agg(F.max("run_date").alias("latest_run_date"), F.max_by("n", "run_date").alias("n_articles"))


def q_slugify(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", slugify("text").alias("slug"))


QUERIES = {
    "meaningful_filter": q_meaningful_filter,
    "digest_rank": q_digest_rank,
    "recommendation_counts": q_recommendation_counts,
    "digest_sections": q_digest_sections,
    "digest_topline": q_digest_topline,
    "digest_cards": q_digest_cards,
    "digest_report": q_digest_report,
    "manual_report": q_manual_report,
    "triage_summary": q_triage_summary,
    "analysis_archive": q_analysis_archive,
    "latest_snapshot": q_latest_snapshot,
    "slugify": q_slugify,
}
