"""Article extraction over a page table (one narrow projection per stage).

Each stage is its own column so Catalyst keeps the expensive string work from
being inlined (and re-run) into every later reference; the whole extraction is a
single map stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import charsets
from gleaner.functions import constants as C
from gleaner.functions import html as H
from gleaner.functions.text import clean_whitespace, truncate_text
from gleaner.functions.urls import url_authority, url_scheme

FETCH_TIMEOUT_S = 20


def decode_page(body: Column, content_type: Column, max_bytes: int = C.MAX_DOWNLOAD_BYTES) -> Column:
    """Bytes -> text: at most ``max_bytes``, charset from the content type (utf-8 by default), malformed
    sequences replaced by U+FFFD; it never fails. NULL for the charsets that ``decode_pages`` leaves to
    its Arrow step and for unknown ones, which the status ladder reports as fetch-error."""
    return charsets.decode_bytes(F.substring(body, 1, max_bytes), charsets.codec(content_type))


def decode_pages(pages: DataFrame, max_bytes: int = C.MAX_DOWNLOAD_BYTES, body: str = "body") -> DataFrame:
    """Landed pages with ``html`` decoded from ``body``. Only pages in a charset of several bytes outside
    Unicode take the Arrow step; all others stay in built-in functions."""
    several = charsets.is_multibyte(charsets.codec(F.col("content_type")))
    capped = F.substring(body, 1, max_bytes)
    plain = pages.where(~several).withColumn("html", decode_page(F.col(body), F.col("content_type"), max_bytes))
    return plain.unionByName(pages.where(several).withColumn("html", charsets.decode_multibyte(capped, charsets.codec(F.col("content_type")))))


#: (element, attribute, value) selectors in order of preference
META_SELECTORS = {
    "title": [("meta", "property", "og:title"), ("meta", "name", "twitter:title"), ("title", None, None)],
    "site_name_meta": [("meta", "property", "og:site_name")],
    "byline": [("meta", "name", "author"), (None, "rel", "author")],
    "published_date": [("meta", "property", "article:published_time"), ("meta", "name", "date"), ("meta", "name", "publish_date"), ("time", "datetime", None)],
}


def metadata(page: Column, els: Column) -> Column:
    """struct(title, site_name_meta, byline, published_date): per field the first selector that says something."""
    all_ = [s for selectors in META_SELECTORS.values() for s in selectors]

    def fields(texts):
        out, at = [], 1
        for name, selectors in META_SELECTORS.items():
            said = F.filter(F.slice(texts, at, len(selectors)), lambda t: t != "")
            out.append(F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")).alias(name))
            at += len(selectors)
        return F.struct(*out)

    return H.bind(H.selected_texts(page, els, all_), fields)


def extract_stages(pages: DataFrame, html_col: str = "html", url_col: str = "url", max_containers: int = C.MAX_FALLBACK_CONTAINERS) -> DataFrame:
    """Add the intermediate extraction columns (prefixed ``x_``) to a page table.

    Extraction is CPU-heavy per row: give the page scan at least one partition per
    core first (``operators.partitioning.spread``) when it comes from few files."""
    c = F.col
    p = pages.withColumn("x_raw", c(html_col))
    p = p.withColumn("x_doc", H.without_raw(c("x_raw")))
    p = p.withColumn("x_els0", H.elements(c("x_doc")))
    p = p.withColumn("x_meta", metadata(c("x_doc"), c("x_els0")))
    p = p.withColumn("x_clean", H.without_boilerplate(c("x_doc"), c("x_els0"))).drop("x_doc", "x_els0")
    p = p.withColumn("x_els", H.elements(c("x_clean"))).withColumn("x_runs", H.text_runs(c("x_clean")))
    p = p.withColumn("x_pref", H.bind(c("x_els"), H.preferred_candidates))
    p = p.withColumn("x_cands", F.when(F.size("x_pref") > 0, c("x_pref")).otherwise(H.fallback_candidates(c("x_els"), max_containers))).drop("x_pref")
    p = p.withColumn("x_inner", H.measured(c("x_els"), c("x_runs")))
    p = p.withColumn("x_scored", H.scored_candidates(c("x_cands"), c("x_inner"), c("x_runs"))).drop("x_cands", "x_inner")
    p = p.withColumn("x_best", H.best_candidate(c("x_scored")))
    p = p.withColumn("x_blocks", F.when(c("x_best").isNull(), F.array().cast(H.BLOCK)).otherwise(H.block_texts(c("x_els"), c("x_runs"), c("x_best"))))
    p = p.withColumn("x_kept", F.filter("x_blocks", H.keep_block))
    p = p.withColumn("x_dedup", H.dedup_blocks(c("x_kept")))
    main_text = (
        F.when(c("x_best").isNull(), H.joined_text(c("x_runs"), "\n"))
        .when(F.size("x_kept") == 0, H.element_text(c("x_runs"), c("x_best"), "\n"))
        .otherwise(clean_whitespace(F.array_join(F.transform("x_dedup", lambda b: b["text"]), "\n\n")))
    )
    p = p.withColumn("x_main", main_text)
    p = p.withColumn("x_text", truncate_text(clean_whitespace(c("x_main"))))
    return p.withColumn("x_site", F.coalesce(F.nullif(c("x_meta.site_name_meta"), F.lit("")), url_authority(c(url_col))))


def extracted_article(p: DataFrame, url_col: str = "url") -> Column:
    """The ExtractedArticle record (status ladder over landed fetch columns)."""
    url = F.col(url_col)
    scheme = url_scheme(url)
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    fetch = F.coalesce(F.col("fetch_status"), F.lit("ok"))
    fetch_error = F.coalesce(F.col("fetch_error"), F.lit("")) if "fetch_error" in p.columns else F.lit("")
    ctl = F.lower(ct)
    n = F.length("x_text")
    status = (
        F.when(~scheme.isin("http", "https"), F.lit("unsupported-url"))
        .when(fetch != "ok", fetch)
        .when((ct != "") & ~ctl.contains("html") & ~ctl.contains("xml"), F.lit("non-html"))
        .when(F.col("x_raw").isNull(), F.lit("fetch-error"))
        .when(n < C.MIN_EXTRACTED_CHARS, F.lit("too-short"))
        .otherwise(F.lit("ok"))
    )
    parsed = status.isin("too-short", "ok")
    error = (
        F.when(status == "unsupported-url", F.lit(C.MSG_UNSUPPORTED_URL))
        .when(status == "timeout", F.lit(C.MSG_TIMEOUT.format(seconds=FETCH_TIMEOUT_S)))
        .when((status == "fetch-error") & (fetch == "ok") & charsets.codec(ct).isNull(), F.concat(F.lit(C.MSG_UNKNOWN_CHARSET), charsets.charset(ct)))
        .when(status.isin("http-error", "url-error", "fetch-error"), fetch_error)
        .when(status == "non-html", F.concat(F.lit(C.MSG_NON_HTML), ct))
        .when(status == "too-short", F.format_string(C.MSG_TOO_SHORT.format(n="%d"), n))
        .otherwise(F.lit(""))
    )

    def parsed_or_empty(c):
        return F.when(parsed, c).otherwise(F.lit(""))

    return F.struct(
        url.alias("url"),
        (status == "ok").alias("ok"),
        parsed_or_empty(F.col("x_text")).alias("text"),
        parsed_or_empty(F.col("x_meta.title")).alias("title"),
        parsed_or_empty(F.col("x_site")).alias("site_name"),
        parsed_or_empty(F.col("x_meta.byline")).alias("byline"),
        parsed_or_empty(F.col("x_meta.published_date")).alias("published_date"),
        status.alias("status"),
        error.alias("error"),
        F.when(parsed, n).otherwise(F.lit(0)).alias("content_chars"),
    )


def extract_articles(pages_raw: DataFrame, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages_raw(url, content_type, fetch_status, html, ...) -> one ExtractedArticle row per page."""
    staged = extract_stages(pages_raw, url_col=url_col)
    rec = extracted_article(staged, url_col)
    return staged.select(*(keep or []), rec.alias("a")).select(*(keep or []), "a.*")
