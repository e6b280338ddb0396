"""Registered page-extraction queries over ``pages`` / ``pages_raw`` and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import clean_whitespace, truncate_text
from gleaner.operators import pages as P
from gleaner.operators.partitioning import broadcast_if_small
from gleaner.plans import fixtures as X


def _stages(spark, sf_dir):
    return P.extract_stages(X.pages_raw(spark, sf_dir))


def explode_rows(df: DataFrame, keep: list[str], col: str, names: tuple[str, str]) -> DataFrame:
    """posexplode without Spark's inferred ``size(array) > 0`` filter: that filter is
    pushed below the stage projections and would inline (and re-run) the whole
    extraction chain. The outer form plus a null filter keeps the stages as columns."""
    x = df.select(*keep, F.posexplode_outer(col).alias(*names))
    return x.where(F.col(names[0]).isNotNull())


def _explode_blocks(df: DataFrame, col: str) -> DataFrame:
    x = explode_rows(df, ["page_id"], col, ("pos", "b"))
    return x.select("page_id", F.col("pos").cast("int").alias("pos"), F.col("b.tag").alias("tag"), F.col("b.text").alias("text"))


def q_clean_whitespace(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_whitespace("text").alias("cleaned"))


def q_text_truncate(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    t = truncate_text(F.col("text"))
    return d.select("doc_id", F.length(t).alias("n_chars"), t.alias("text"))


def q_page_metadata(spark, sf_dir):
    s = _stages(spark, sf_dir)
    return s.select("page_id", F.col("x_meta.title").alias("title"), F.col("x_site").alias("site_name"),
                    F.col("x_meta.byline").alias("byline"), F.col("x_meta.published_date").alias("published_date"))


def q_page_strip_boilerplate(spark, sf_dir):
    s = _stages(spark, sf_dir)
    return s.select("page_id", F.length("x_clean").alias("n_chars"), F.col("x_clean").alias("stripped"))


def q_page_container_score(spark, sf_dir):
    s = explode_rows(_stages(spark, sf_dir), ["page_id"], "x_scored", ("idx", "c"))
    c = F.col("c")
    return s.select("page_id", F.col("idx").cast("int").alias("idx"), c["name"].alias("name"), c["start"].alias("start"),
                    c["text_len"].alias("text_len"), c["para_len"].alias("para_len"), c["n_p"].alias("n_p"), c["n_h"].alias("n_h"),
                    c["link_len"].alias("link_len"), c["score"].alias("score"))


def q_page_best_container(spark, sf_dir):
    s = _stages(spark, sf_dir)
    b = F.col("x_best")
    return s.select("page_id", b["name"].alias("name"), b["start"].alias("start"), b["score"].alias("score"),
                    F.size("x_scored").alias("n_candidates"))


def q_page_blocks(spark, sf_dir):
    return _explode_blocks(_stages(spark, sf_dir), "x_blocks")


def q_page_block_filter(spark, sf_dir):
    return _explode_blocks(_stages(spark, sf_dir), "x_kept")


def q_page_block_dedup(spark, sf_dir):
    return _explode_blocks(_stages(spark, sf_dir), "x_dedup")


def q_page_article_text(spark, sf_dir):
    s = _stages(spark, sf_dir)
    return s.select("page_id", F.length("x_main").alias("n_chars"), F.col("x_main").alias("text"))


def q_page_status(spark, sf_dir):
    return P.extract_articles(X.pages_raw(spark, sf_dir), keep=["page_id"])


def q_page_scan_decode(spark, sf_dir):
    """Pages as landed bytes (utf-8 encoded), decoded back up to a byte cap that cuts characters."""
    raw = X.pages_raw(spark, sf_dir).select("page_id", "content_type", F.encode("html", "UTF-8").alias("body"))
    return raw.select("page_id", F.length("body").alias("n_bytes"), P.decode_page(F.col("body"), F.lit("text/html; charset=utf-8"), 1001).alias("text"))


QUERIES = {
    "clean_whitespace": q_clean_whitespace,
    "text_truncate": q_text_truncate,
    "page_metadata": q_page_metadata,
    "page_strip_boilerplate": q_page_strip_boilerplate,
    "page_container_score": q_page_container_score,
    "page_best_container": q_page_best_container,
    "page_blocks": q_page_blocks,
    "page_block_filter": q_page_block_filter,
    "page_block_dedup": q_page_block_dedup,
    "page_article_text": q_page_article_text,
    "page_status": q_page_status,
    "page_scan_decode": q_page_scan_decode,
}


# --- joined triage: candidates x extracted pages x prompt ---------------------------

from gleaner.functions.urls import normalize_url  # noqa: E402
from gleaner.operators import analysis as A  # noqa: E402
from gleaner.operators import discovery as D  # noqa: E402
from gleaner.plans.discovery_queries import _candidates  # noqa: E402
from gleaner.session import ensure_checkpoint_dir  # noqa: E402


def _top(spark, sf_dir):
    top = D.best_topk(_candidates(spark, sf_dir), cap=X.BACKFILL_CAP, limit=X.BACKFILL_LIMIT)
    r = F.col("rank")
    title = F.when(r % 3 == 0, F.lit("")).when(r % 3 == 1, F.col("url")).otherwise(F.col("title"))
    # the k selected rows are used twice (semi-join filter and final join): checkpoint
    # them (k rows, to the shared checkpoint folder) instead of recomputing discovery
    ensure_checkpoint_dir(spark)
    return top.select(F.col("rank").cast("int").alias("rank"), "url", title.alias("title"), "content").checkpoint(eager=True)


def extracted_for(pages_raw: DataFrame, wanted_urls: DataFrame) -> DataFrame:
    """Extract only the pages whose normalised url is wanted (late materialisation).

    ``wanted_urls`` is the selected top-k; it is broadcast for the semi-join when it
    has been counted to be small, and the page table is then not shuffled. One page
    per url is kept (lowest page_id) with a partial aggregate."""
    keyed = pages_raw.withColumn("url", normalize_url("url"))
    wanted = keyed.join(broadcast_if_small(wanted_urls.select("url").distinct()), "url", "left_semi")
    ex = P.extract_articles(wanted, keep=["page_id"])
    rec = F.struct(*[c for c in ex.columns if c not in ("page_id",)])
    one = ex.groupBy("url").agg(F.min_by(rec, F.col("page_id")).alias("x"))
    return one.select("x.*")


def _enriched(spark, sf_dir):
    top = _top(spark, sf_dir)
    return A.enrich_with_extraction(top, extracted_for(X.pages_raw(spark, sf_dir), top))


def q_enrich_with_extraction(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select("rank", "url", "title", "content_source", F.coalesce(F.col("extraction.status"), F.lit("")).alias("extraction_status"),
                    F.coalesce(F.col("extraction.content_chars"), F.lit(0)).alias("content_chars"), "analysis_content")


def q_prompt_build(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    ex = F.col("extraction")
    prompt = A.prompt(F.lit(X.TOPIC), F.col("title"), F.col("url"), A.metadata_json(ex), F.col("content_source"),
                      F.coalesce(ex["status"], F.lit("")), F.col("analysis_content"))
    return e.select("rank", "url", prompt.alias("prompt"))


QUERIES["enrich_with_extraction"] = q_enrich_with_extraction
QUERIES["prompt_build"] = q_prompt_build
