"""Model-output recovery and normalisation: edge tables (documented deviations noted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators.analysis import analyse_outputs


def analyse(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r["analysis"] for r in analyse_outputs(df).orderBy("i").collect()]


def test_clamp_score_edges(spark):
    vals = ['"85"', '" 85 "', "85.9", "true", "null", "[1]", "99999999999", '"85.5"', '"1e2"', "-5", "150"]
    raws = ['{"signal_score": %s, "summary": "s"}' % v for v in vals]
    got = [a["signal_score"] for a in analyse(spark, raws)]
    assert got == [85, 85, 85, 1, 0, 0, 100, 0, 0, 0, 100]


def test_string_list_forms(spark):
    raws = [
        '{"tags": ["  a ", "", null, true, 3], "summary": "s"}',
        '{"tags": "single", "summary": "s"}',
        '{"tags": "   ", "summary": "s"}',
        '{"tags": 5, "summary": "s"}',
        '{"summary": "s"}',
    ]
    got = [a["tags"] for a in analyse(spark, raws)]
    assert got == [["a", "None", "True", "3"], ["single"], [], [], []]


def test_recovery_forms(spark):
    obj = '{"recommendation": " READ ", "summary": "ok"}'
    raws = [
        obj,
        "```json\n" + obj + "\n```",
        "⠋⠙ " + obj,
        "thinking... " + obj + " trailing {junk",
        '{"broken": ' + obj,
        '```json\n{"recommendation": }\n```',
        "no json here",
        None,
    ]
    a = analyse(spark, raws)
    assert [x["recommendation"] for x in a[:5]] == ["read"] * 5
    assert [x["analysis_error"] is not None for x in a] == [False] * 5 + [True] * 3
    assert a[7]["analysis_error"] == "Model output missing."
    assert a[6]["tags"] == ["analysis-error"] and a[6]["claims_to_verify"] == [a[6]["summary"]]


def test_normalize_defaults(spark):
    raw = '{"recommendation": "BUY", "summary": "", "skeptical_take": null, "why_selected": 7}'
    a = analyse(spark, [raw])[0]
    assert a["recommendation"] == "watch"
    assert a["summary"] == raw[:500]
    assert a["skeptical_take"] == "None"
    assert a["why_selected"] == "7"
    assert a["suggested_action"] == ""


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "{}")], "i int, raw string")
    plan = analyse_outputs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    _ = F
