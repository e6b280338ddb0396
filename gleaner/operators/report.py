"""Digest report: ranking, counts, sections, cards and the report as ordered lines.

The report is produced as rows ``(topic, block, item, line, text)`` whose order key
is total, so a text sink can write it with a distributed sort; no topic's
articles are ever gathered into one task or one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.text import py_strip
from gleaner.operators.ranking import row_number_within
from gleaner.session import ensure_checkpoint_dir


def meaningful(c: Column) -> Column:
    """False for null or a trimmed, lower-cased value in the stop set."""
    return c.isNotNull() & ~F.lower(py_strip(c)).isin(*C.EMPTY_FIELD_VALUES)


def meaningful_items(arr: Column) -> Column:
    return F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: meaningful(x))


def recommendation_order(rec: Column) -> Column:
    """read < skim < watch < ignore; unknown values sort with ignore."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.RECOMMENDATION_ORDER.items() for x in kv]), rec), F.lit(3))


def digest_rank(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Position of every article in its topic's digest (skew-safe numbering)."""
    keyed = df.withColumn("_rec_order", recommendation_order(F.col("analysis.recommendation")))
    order = [F.col("_rec_order").asc(), F.col("analysis.signal_score").desc(), F.col("analysis.fluff_score").asc(), F.col("pos").asc()]
    return row_number_within(keyed, [topic], order, name="digest_rank").drop("_rec_order")


def recommendation_counts(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Zero-filled counts of the four recommendations per topic (one partial aggregate)."""
    rec = F.col("analysis.recommendation")
    counts = df.groupBy(topic).agg(*[F.count_if(rec == r).alias(f"n_{r}") for r in C.VALID_RECOMMENDATIONS])
    out = topics.join(counts, topic, "left")
    return out.select(topic, *[F.coalesce(F.col(f"n_{r}"), F.lit(0)).cast("long").alias(f"n_{r}") for r in C.VALID_RECOMMENDATIONS])


def with_sections(ranked: DataFrame, topic: str = "topic") -> DataFrame:
    """kept / ignored split with the position inside the section."""
    sec = F.when(F.col("analysis.recommendation") != "ignore", F.lit("kept")).otherwise(F.lit("ignored"))
    df = ranked.withColumn("section", sec)
    return row_number_within(df, [topic, "section"], [F.col("digest_rank").asc()], name="section_rank")


def sectioned(articles: DataFrame, topic: str = "topic") -> DataFrame:
    """Articles with ``section`` and ``section_rank``, numbered once and on keys only.

    Kept articles are numbered before ignored ones, so an ignored one's place is its
    number less the kept ones of its topic. The articles are checkpointed as they come;
    only keys are sorted, and the texts meet the numbers in one join on a row id."""
    ensure_checkpoint_dir(articles.sparkSession)
    rec = F.col("analysis.recommendation")
    sec = F.when(rec != "ignore", F.lit("kept")).otherwise(F.lit("ignored"))
    rows = articles.withColumn("section", sec).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    keys = rows.select(
        F.col(topic).alias("_topic"), F.col("section").alias("_section"), recommendation_order(rec).alias("_rec"),
        F.col("analysis.signal_score").alias("_signal"), F.col("analysis.fluff_score").alias("_fluff"), F.col("pos").alias("_pos"), F.col("_id").alias("_row"),
    )
    order = [F.col("_section").desc(), F.col("_rec"), F.col("_signal").desc(), F.col("_fluff"), F.col("_pos"), F.col("_row")]
    numbered = row_number_within(keys, ["_topic"], order, name="_n")
    kept = keys.groupBy(F.col("_topic").alias("_t")).agg(F.count_if(F.col("_section") == "kept").alias("_kept"))
    place = F.when(F.col("_section") == "kept", F.col("_n")).otherwise(F.col("_n") - F.col("_kept"))
    places = numbered.join(kept, F.col("_topic").eqNullSafe(F.col("_t"))).select("_row", place.alias("section_rank"))
    return rows.join(places, F.col("_id") == F.col("_row")).drop("_id", "_row")


def topline(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Counts line and best candidate (first in ranking, may be an ignored one).

    min_by over the rank struct is a partial aggregate, so a hot topic is reduced
    map-side. Topics without articles keep a row with a null top line.
    """
    a = F.col("analysis")
    key = F.struct(recommendation_order(a["recommendation"]).alias("r"), (-a["signal_score"]).alias("s"), a["fluff_score"].alias("f"), F.col("pos").alias("p"))
    rec = a["recommendation"]
    agg = df.groupBy(topic).agg(
        F.min_by(F.coalesce(F.col("title"), F.lit(C.UNTITLED)), key).alias("best_title"),
        *[F.count_if(rec == r).alias(f"n_{r}") for r in C.VALID_RECOMMENDATIONS],
    )
    line = F.format_string(C.COUNTS_LINE.format(read="%d", skim="%d", watch="%d", ignore="%d"),
                           F.col("n_read"), F.col("n_skim"), F.col("n_watch"), F.col("n_ignore"))
    return topics.join(agg.select(topic, "best_title", line.alias("counts_line")), topic, "left")


def card_fields(df: DataFrame) -> DataFrame:
    """One structured card per article, with the display fallbacks applied."""
    a = F.col("analysis")
    ex = F.col("extraction")
    rec = F.lower(a["recommendation"])
    src = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.nullif(ex["site_name"], F.lit("")), F.lit(C.UNKNOWN_SOURCE))
    pub = F.substring(F.coalesce(F.nullif(F.col("published"), F.lit("")), F.nullif(ex["published_date"], F.lit("")), F.lit("")), 1, 10)

    def keep(c):
        return F.when(meaningful(c), c).otherwise(F.lit(""))

    details = {k: meaningful_items(a[k]) for k in C.LIST_FIELDS[:4]}
    return df.select(
        "*",
        rec.alias("card_recommendation"),
        F.upper(rec).alias("badge"),
        F.coalesce(F.col("title"), F.lit(C.UNTITLED)).alias("card_title"),
        src.alias("display_source"),
        pub.alias("display_published"),
        F.coalesce(F.col("content_source"), F.lit("unknown")).alias("card_content_source"),
        F.coalesce(ex["status"], F.lit("unknown")).alias("card_status"),
        F.when(meaningful(a["summary"]), a["summary"]).otherwise(F.lit(C.NO_SUMMARY_TEXT)).alias("card_summary"),
        keep(a["skeptical_take"]).alias("card_take"),
        keep(a["suggested_action"]).alias("card_action"),
        keep(a["why_selected"]).alias("card_why"),
        meaningful_items(a["tags"]).alias("card_tags"),
        F.coalesce(a["analysis_error"], F.lit("")).alias("card_error"),
        *[v.alias(f"card_{k}") for k, v in details.items()],
        (F.greatest(*[F.size(v) for v in details.values()]) > 0).alias("card_has_details"),
    )


DETAIL_TITLES = C.DETAIL_TITLES


def card_lines(cards: DataFrame) -> Column:
    """The card as an array of text lines (optional lines left out)."""
    meta = F.concat_ws(
        " · ",
        F.col("display_source"),
        F.when(F.col("display_published") != "", F.col("display_published")),
        F.concat(F.lit("content: "), F.col("card_content_source")),
        F.concat(F.lit("extraction: "), F.col("card_status")),
    )
    a = F.col("analysis")
    scores = F.concat(
        F.lit("Signal "), a["signal_score"].cast("string"), F.lit(" · Fluff "), a["fluff_score"].cast("string"),
        F.lit(" · Depth "), a["technical_depth"].cast("string"), F.lit(" · Novelty "), a["novelty"].cast("string"),
        F.lit(" · Relevance "), a["relevance"].cast("string"),
    )

    def opt(cond, text):
        return F.when(cond, text)

    lines = [
        F.concat(F.lit("## ["), F.col("badge"), F.lit("] "), F.col("card_title")),
        meta,
        scores,
        F.col("card_summary"),
        opt(F.col("card_take") != "", F.concat(F.lit("Skeptical take: "), F.col("card_take"))),
        opt(F.col("card_action") != "", F.concat(F.lit("Suggested action: "), F.col("card_action"))),
        opt(F.col("card_why") != "", F.concat(F.lit("Why selected: "), F.col("card_why"))),
        opt(F.size("card_tags") > 0, F.concat(F.lit("Tags: "), F.array_join("card_tags", ", "))),
        opt(F.col("card_error") != "", F.concat(F.lit("Analysis error: "), F.col("card_error"))),
        *[opt(F.size(f"card_{k}") > 0, F.concat(F.lit(title + ": "), F.array_join(f"card_{k}", "; "))) for k, title in DETAIL_TITLES],
        opt(F.coalesce(F.col("url"), F.lit("")) != "", F.concat(F.lit("Read source: "), F.col("url"))),
        F.lit(""),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def header_lines(topic: Column, generated_at: str, model: str, timeout_s: int | None) -> Column:
    lines = [
        F.concat(F.lit(C.DIGEST_TITLE_PREFIX), topic),
        F.lit(""),
        F.lit(f"Generated: {generated_at}"),
        F.lit(f"Model: `{model}`"),
    ]
    if timeout_s is not None:
        lines.append(F.lit(f"Model timeout: `{timeout_s}s`"))
    lines += [F.lit(""), F.lit(C.DIGEST_INTRO), F.lit("")]
    return F.array(*lines)


def _explode_lines(df: DataFrame, topic: str, block: int, item: Column, arr: Column) -> DataFrame:
    x = df.select(F.col(topic).alias("topic"), F.lit(block).alias("block"), item.cast("long").alias("item"), F.posexplode(arr).alias("line", "text"))
    return x.select("topic", "block", "item", F.col("line").cast("int").alias("line"), "text")


def digest_lines(articles: DataFrame, topics: DataFrame, generated_at: str, model: str, timeout_s: int = 300, topic: str = "topic") -> DataFrame:
    """The per-topic digest as ordered lines: header, top line, kept cards (or the
    'no articles' text), rejected cards. Order by (topic, block, item, line).

    The articles are numbered once (``sectioned``) and kept in a checkpoint; the top
    line, section heads and cards all read that table, so the source join runs once."""
    ranked = sectioned(articles, topic).checkpoint(eager=True)
    cards = card_fields(ranked)
    head = _explode_lines(topics, topic, 0, F.lit(0), header_lines(F.col(topic), generated_at, model, timeout_s))
    tl = topline(ranked, topics, topic).where(F.col("best_title").isNotNull())
    top = _explode_lines(tl, topic, 1, F.lit(0), F.array(F.col("counts_line"), F.concat(F.lit(C.BEST_CANDIDATE_PREFIX), F.col("best_title")), F.lit("")))
    kept = cards.where(F.col("section") == "kept")
    ignored = cards.where(F.col("section") == "ignored")
    per_section = ranked.groupBy(topic).agg(F.count_if(F.col("section") == "kept").alias("n_kept"), F.count_if(F.col("section") == "ignored").alias("n_ign"))
    sections = topics.join(per_section, topic, "left")
    has_kept = F.coalesce(F.col("n_kept"), F.lit(0)) > 0
    kept_head = _explode_lines(sections.where(has_kept), topic, 2, F.lit(0), F.array(F.lit(C.WORTH_ATTENTION), F.lit("")))
    none_text = _explode_lines(sections.where(~has_kept), topic, 2, F.lit(0),
                               F.array(F.lit(C.WORTH_ATTENTION), F.lit(""), F.lit(C.NO_ARTICLES_TEXT), F.lit("")))
    kept_cards = _explode_lines(kept, topic, 3, F.col("section_rank"), card_lines(kept))
    ign_head = _explode_lines(sections.where(F.coalesce(F.col("n_ign"), F.lit(0)) > 0), topic, 4, F.lit(0),
                              F.array(F.lit(C.REJECTED_SECTION), F.lit("")))
    ign_cards = _explode_lines(ignored, topic, 5, F.col("section_rank"), card_lines(ignored))
    return head.unionByName(top).unionByName(kept_head).unionByName(none_text).unionByName(kept_cards).unionByName(ign_head).unionByName(ign_cards)


def manual_lines(articles: DataFrame, topic_label: str, generated_at: str, model: str) -> DataFrame:
    """Manual report: header then every card in input order (not ranked)."""
    cards = card_fields(articles.withColumn("topic", F.lit(topic_label)))
    header = [
        F.lit(C.MANUAL_TITLE_PREFIX + topic_label), F.lit(""), F.lit(f"Generated: {generated_at}"),
        F.lit(f"Model: `{model}`"), F.lit(""), F.lit(C.MANUAL_INTRO), F.lit(""),
    ]
    spark = articles.sparkSession
    head = spark.range(1).select(F.lit(topic_label).alias("topic"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("item"),
                                 F.posexplode(F.array(*header)).alias("line", "text"))
    head = head.select("topic", "block", "item", F.col("line").cast("int").alias("line"), "text")
    body = _explode_lines(cards, "topic", 1, F.col("pos"), card_lines(cards))
    return head.unionByName(body)


def triage_summary(df: DataFrame) -> DataFrame:
    """The fixed console projection of a triaged article."""
    a = F.col("analysis")
    ex = F.col("extraction")
    return df.select(
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")).alias("display_title"),
        F.col("url"),
        F.upper(a["recommendation"]).alias("recommendation"),
        a["signal_score"].alias("signal"),
        a["fluff_score"].alias("fluff"),
        a["technical_depth"].alias("tech_depth"),
        F.coalesce(F.col("content_source"), F.lit("unknown")).alias("content_source"),
        F.coalesce(ex["status"], F.lit("unknown")).alias("extraction_status"),
        F.coalesce(ex["content_chars"], F.lit(0)).alias("chars"),
        F.coalesce(a["summary"], F.lit("")).alias("summary"),
        F.coalesce(a["skeptical_take"], F.lit("")).alias("skeptical_take"),
        F.coalesce(a["suggested_action"], F.lit("")).alias("suggested_action"),
    )
