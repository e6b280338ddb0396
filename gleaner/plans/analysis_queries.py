"""Registered model-output queries over the derived ``model_outputs`` view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.model_output import first_json_object, json_array_block
from gleaner.functions.text import strip_spinner
from gleaner.operators.analysis import analyse_outputs, join_analysis
from gleaner.operators import discovery as D
from gleaner.plans import fixtures as X
from gleaner.operators.partitioning import spread
from gleaner.plans.discovery_queries import _candidates

SEP = "||"
SAFE_TEXT = r'[\x{0}-\x{1F}"\\{}]'
RECS = ["read", "skim", "watch", "ignore"]


def _s(c) -> Column:
    return c.cast("string")


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model text per document, in twelve forms chosen by doc_id % 12 (FIXTURES.md)."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    s = F.regexp_replace(F.col("text"), SAFE_TEXT, " ")
    i = F.col("doc_id")
    rec = F.element_at(F.array(*[F.lit(r) for r in RECS]), (i % 4 + 1).cast("int"))
    obj = F.concat(
        F.lit('{"recommendation": "'), rec,
        F.lit('", "signal_score": '), _s(i * 37 % 101),
        F.lit(', "fluff_score": '), _s(i * 53 % 101),
        F.lit(', "technical_depth": '), _s(i % 90),
        F.lit(', "novelty": '), _s(i % 70),
        F.lit(', "relevance": '), _s(i % 60),
        F.lit(', "summary": "'), s,
        F.lit('", "why_selected": "Source '), F.col("source"),
        F.lit('", "technically_sound_claims": ["claim '), _s(i), F.lit('", ""], "marketing_or_hype": [], "claims_to_verify": "verify '),
        F.col("lang"),
        F.lit('", "why_it_matters_to_me": ["  x  ", null, true, 3], "skeptical_take": null, "suggested_action": "  act  ", "tags": ["'),
        F.col("lang"), F.lit('", "none called out."]}'),
    )
    strings = F.concat(
        F.lit('{"recommendation": " Skim ", "signal_score": "85", "fluff_score": " 12 ", "technical_depth": "85.5", '
              '"novelty": 85.9, "relevance": true, "summary": "", "why_selected": "w'), _s(i), F.lit('", "tags": []}'),
    )
    odd = F.concat(
        F.lit('{"recommendation": "BUY", "signal_score": 150, "fluff_score": -5, "technical_depth": 99999999999, '
              '"novelty": null, "relevance": [1], "summary": "'), s,
        F.lit('", "tags": "single-tag", "claims_to_verify": "   "}'),
    )
    form = i % 12
    raw = (
        F.when(form == 0, obj)
        .when(form == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit(C.SPINNER_FRAMES[:3] + " \n"), obj))
        .when(form == 3, F.concat(F.lit("Here is my analysis: "), obj, F.lit(" Hope this helps {not json}.")))
        .when(form == 4, F.concat(F.lit('{"broken": '), obj))
        .when(form == 5, F.lit('```json\n{"recommendation": "read", "signal_score": }\n```'))
        .when(form == 6, F.concat(F.lit("The model could not decide about "), s))
        .when(form == 7, strings)
        .when(form == 8, odd)
        .when(form == 10, F.concat(F.lit("[1, 2] "), s))
        .when(form == 11, F.lit('```json\n{"recommendation": "read"}, {"recommendation": "skim"}\n```'))
    )
    return spread(d.select("doc_id", raw.alias("raw")))


def _joined(a: Column) -> Column:
    return F.array_join(a, SEP)


def _analysis_cols(a: str = "analysis") -> list[Column]:
    x = F.col(a)
    return [
        x["recommendation"].alias("recommendation"),
        *[x[k].alias(k) for k in C.SCORE_FIELDS],
        *[x[k].alias(k) for k in C.TEXT_FIELDS],
        *[_joined(x[k]).alias(k) for k in C.LIST_FIELDS],
        x["analysis_error"].alias("analysis_error"),
    ]


def q_strip_spinner(spark, sf_dir):
    return model_outputs(spark, sf_dir).select("doc_id", strip_spinner("raw").alias("cleaned"))


def q_json_object_extract(spark, sf_dir):
    m = model_outputs(spark, sf_dir).withColumn("p", first_json_object("raw"))
    obj = F.col("p.obj")
    return m.select(
        "doc_id",
        obj.isNotNull().alias("found"),
        F.col("p.error").alias("error"),
        F.try_variant_get(obj, "$.recommendation", "string").alias("recommendation_raw"),
    )


def q_clamp_score(spark, sf_dir):
    m = analyse_outputs(model_outputs(spark, sf_dir))
    return m.select("doc_id", *[F.col("analysis")[k].alias(k) for k in C.SCORE_FIELDS])


def q_string_list(spark, sf_dir):
    m = analyse_outputs(model_outputs(spark, sf_dir))
    return m.select("doc_id", *[_joined(F.col("analysis")[k]).alias(k) for k in C.LIST_FIELDS])


def q_analysis_normalize(spark, sf_dir):
    m = analyse_outputs(model_outputs(spark, sf_dir))
    return m.select("doc_id", *_analysis_cols())


def q_analysis_error_route(spark, sf_dir):
    m = analyse_outputs(model_outputs(spark, sf_dir))
    a = F.col("analysis")
    return m.select(
        "doc_id",
        a["analysis_error"].isNotNull().alias("is_error"),
        a["analysis_error"].alias("analysis_error"),
        a["recommendation"].alias("recommendation"),
        a["why_selected"].alias("why_selected"),
        _joined(a["claims_to_verify"]).alias("claims_to_verify"),
        _joined(a["tags"]).alias("tags"),
    )


def q_analysis_join(spark, sf_dir):
    top = D.best_topk(_candidates(spark, sf_dir), cap=X.BACKFILL_CAP, limit=X.BACKFILL_LIMIT)
    outputs = model_outputs(spark, sf_dir).where(F.col("doc_id") % 7 != 3).withColumnRenamed("doc_id", "pos")
    j = join_analysis(top, outputs, "pos")
    a = F.col("analysis")
    return j.select(F.col("rank").cast("int").alias("rank"), "url", a["recommendation"].alias("recommendation"),
                    a["signal_score"].alias("signal_score"), a["analysis_error"].alias("analysis_error"))


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-discovery responses derived from documents and pages (three forms)."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    s = F.regexp_replace(F.col("text"), SAFE_TEXT, " ")
    arr = F.concat(
        F.lit('[{"title": "T'), _s(F.col("doc_id")), F.lit('", "url": "https://example.org/'), F.col("lang"), F.lit("/"),
        _s(F.col("doc_id")), F.lit('", "content": "'), s, F.lit('"}, {"title": "'), F.col("lang"), F.lit('", "url": "", "content": ""}]'),
    )
    form = F.col("doc_id") % 3
    text = (
        F.when(form == 0, F.concat(F.lit("Sure, here you go:\n```json\n"), arr, F.lit("\n```\nEnjoy.")))
        .when(form == 1, arr)
        .otherwise(F.concat(F.lit("Sorry, nothing found about "), s))
    )
    return d.select("doc_id", text.alias("response"))


def q_response_array_explode(spark, sf_dir):
    r = response_texts(spark, sf_dir).withColumn("arr", json_array_block("response"))
    ok = r.where(F.col("arr").isNotNull()).select("doc_id", F.posexplode_outer("arr").alias("idx", "a")).where(F.col("idx").isNotNull())
    good = ok.select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("a.title").alias("title"),
                     F.col("a.url").alias("url"), F.col("a.content").alias("content"), F.lit(True).alias("ok"))
    bad = r.where(F.col("arr").isNull()).select(
        "doc_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("content"), F.lit(False).alias("ok"))
    return good.unionByName(bad)


QUERIES = {
    "strip_spinner": q_strip_spinner,
    "json_object_extract": q_json_object_extract,
    "clamp_score": q_clamp_score,
    "string_list": q_string_list,
    "analysis_normalize": q_analysis_normalize,
    "analysis_error_route": q_analysis_error_route,
    "analysis_join": q_analysis_join,
    "response_array_explode": q_response_array_explode,
}
