"""Triage: join candidates to extracted text and model outputs, build prompts,
normalise judgements. Everything is a column expression or an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.model_output import FENCED_OBJECT, MSG_BAD_FENCE, MSG_MISSING, MSG_NO_OBJECT, _whole_json, brace_positions, error_analysis, first_decodable, normalize_analysis
from gleaner.functions.text import strip_spinner
from gleaner.operators.partitioning import broadcast_if_small
from gleaner.session import ensure_checkpoint_dir

ANALYSIS_PROMPT = C.ANALYSIS_PROMPT
PLACEHOLDER_ORDER = C.PLACEHOLDER_ORDER


def analyse_outputs(outputs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add the normalised ``analysis`` struct to a table of raw model outputs.

    The JSON recovery runs once per row into a VARIANT column; the fifteen field
    extractions then read that column instead of re-parsing the text.
    """
    raw = F.col(raw_col)
    p = outputs.withColumn("_cleaned", strip_spinner(raw))
    p = p.withColumn("_fenced", F.regexp_extract(F.col("_cleaned"), FENCED_OBJECT, 1))
    p = p.withColumn("_braces", brace_positions(F.col("_cleaned")))
    p = p.withColumn("_found", first_decodable(F.col("_cleaned"), F.col("_braces")))
    p = p.withColumn("_fenced_obj", _whole_json(F.col("_fenced")))
    fenced = F.col("_fenced") != ""
    p = p.withColumn("_obj", F.when(raw.isNull(), F.lit(None)).when(fenced, F.col("_fenced_obj")).otherwise(F.col("_found")))
    p = p.withColumn("_err", F.when(raw.isNull(), F.lit(MSG_MISSING))
                     .when(fenced & F.col("_fenced_obj").isNull(), F.lit(MSG_BAD_FENCE))
                     .when(~fenced & F.col("_found").isNull(), F.lit(MSG_NO_OBJECT)))
    p = p.drop("_cleaned", "_fenced", "_braces", "_found", "_fenced_obj")
    analysis = F.when(F.col("_obj").isNull(), error_analysis(F.col("_err"))).otherwise(normalize_analysis(F.col("_obj"), raw))
    return p.withColumn("analysis", analysis).drop("_obj", "_err")


def join_analysis(cands: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Left join candidates to analysed outputs; a candidate without output gets the error record.

    Only the outputs of candidates are parsed (late materialisation); their keys are
    broadcast when they have been counted to be few."""
    ensure_checkpoint_dir(cands.sparkSession)
    cands = cands.checkpoint(eager=True)  # read twice below
    outputs = outputs.join(broadcast_if_small(cands.select(key).distinct()), key, "left_semi")
    analysed = analyse_outputs(outputs).select(key, "analysis")
    joined = cands.join(analysed, key, "left")
    missing = error_analysis(F.lit("Model output missing."))
    return joined.withColumn("analysis", F.when(F.col("analysis").isNull(), missing).otherwise(F.col("analysis")))


def enrich_with_extraction(cands: DataFrame, extracted: DataFrame) -> DataFrame:
    """Left join candidates (keyed by url) to extraction rows; pick title and content.

    title: ``title or 'Untitled'``, replaced by the extracted title when it is
    'Untitled' or equals the url and an extracted title exists. content: the
    extracted text when extraction is ok, else the candidate excerpt.
    """
    x = extracted.select(F.col("url"), F.struct(*[c for c in extracted.columns]).alias("extraction"))
    j = cands.join(x, "url", "left")
    ex = F.col("extraction")
    title0 = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(C.UNTITLED))
    ex_title = F.coalesce(ex["title"], F.lit(""))
    title = F.when((ex_title != "") & ((title0 == C.UNTITLED) | (title0 == F.coalesce(F.col("url"), F.lit("")))), ex_title).otherwise(title0)
    ok = F.coalesce(ex["ok"], F.lit(False))
    return j.select(
        *[F.col(c) for c in cands.columns if c != "title"],
        title.alias("title"),
        F.when(ok, ex["text"]).otherwise(F.coalesce(F.col("content"), F.lit(""))).alias("analysis_content"),
        F.when(ok, F.lit(C.CONTENT_SOURCE_EXTRACTED)).otherwise(F.lit(C.CONTENT_SOURCE_FALLBACK)).alias("content_source"),
        ex.alias("extraction"),
    )


def _json_str(c: Column) -> Column:
    """A JSON string literal for c (Spark escapes quotes, backslashes and control chars)."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}\z', "")


def metadata_json(extraction: Column) -> Column:
    """The six extraction metadata fields as an indented JSON object (2-space indent)."""
    e = extraction
    fields = [
        ("extracted_title", _json_str(F.coalesce(e["title"], F.lit("")))),
        ("site_name", _json_str(F.coalesce(e["site_name"], F.lit("")))),
        ("byline", _json_str(F.coalesce(e["byline"], F.lit("")))),
        ("published_date", _json_str(F.coalesce(e["published_date"], F.lit("")))),
        ("extracted_chars", F.coalesce(e["content_chars"], F.lit(0)).cast("string")),
        ("extraction_error", _json_str(F.coalesce(e["error"], F.lit("")))),
    ]
    body = [F.concat(F.lit(f'  "{k}": '), v) for k, v in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *body), F.lit("\n}"))


def prompt(topic: Column, title: Column, url: Column, metadata: Column, content_source: Column, status: Column, content: Column) -> Column:
    """Sequential placeholder replacement (content last), like chained str.replace."""
    values = {"topic": topic, "title": title, "url": url, "metadata": metadata,
              "content_source": content_source, "extraction_status": status, "content": content}
    out = F.lit(ANALYSIS_PROMPT)
    for name in PLACEHOLDER_ORDER:
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(values[name], F.lit("")))
    return out


def articles_from_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Manual submissions: one article per url, titled by the url, with a fixed excerpt."""
    return urls.select(
        F.col(url_col).alias("url"),
        F.col(url_col).alias("title"),
        F.lit(C.MANUAL_CONTENT).alias("content"),
        *[c for c in urls.columns if c != url_col],
    )


def score_with(prompts: DataFrame, scorer, prompt_col: str = "prompt", key_col: str = "url") -> DataFrame:
    """Run a user-supplied batch scorer (the model call) next to the data.

    ``scorer(pandas.Series[str]) -> pandas.Series[str | None]`` maps prompts to raw
    model outputs for one Arrow batch; Spark distributes the batches with
    ``mapInPandas``. The raw text then goes through ``analyse_outputs`` like any
    landed model output, so a failing call becomes an error record, not a failed job.
    """
    def run(batches):
        for pdf in batches:
            out = pdf[[key_col]].copy()
            out["raw"], out["failure"] = None, None
            try:
                out["raw"] = list(scorer(pdf[prompt_col]))
            except Exception:  # noqa: BLE001 - then call by call: only the failing ones become error rows
                for i in out.index:
                    try:
                        out.at[i, "raw"] = list(scorer(pdf.loc[[i], prompt_col]))[0]
                    except Exception as e:  # noqa: BLE001
                        out.at[i, "failure"] = str(e) or type(e).__name__
            yield out

    schema = f"{key_col} string, raw string, failure string"
    scored = prompts.select(F.col(key_col).cast("string").alias(key_col), prompt_col).mapInPandas(run, schema)
    done = analyse_outputs(scored)
    return done.withColumn("analysis", F.when(F.col("failure").isNotNull(), error_analysis(F.col("failure"))).otherwise(F.col("analysis"))).drop("failure")


def discover(mode: str, feed_candidates: DataFrame | None = None, search_candidates: DataFrame | None = None) -> DataFrame:
    """Discovery-mode dispatch: 'feeds' or 'search'; anything else is an error."""
    m = (mode or "").strip().lower()
    if m == "feeds" and feed_candidates is not None:
        return feed_candidates
    if m == "search" and search_candidates is not None:
        return search_candidates
    raise ValueError("discovery mode must be 'feeds' or 'search'")
