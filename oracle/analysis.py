"""DuckDB oracle SQL for model-output parsing and normalisation."""

from __future__ import annotations

from gleaner.functions import constants as C
from oracle.common import PY_WS_CLASS, q, strip
from oracle.discovery import CANDS, _with

SAFE = r'[\x{0}-\x{1F}"\\{}]'
FENCE = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"


def model_outputs_cte() -> str:
    s = f"regexp_replace(text, {q(SAFE)}, ' ', 'g')"
    rec = "(['read','skim','watch','ignore'])[(doc_id % 4) + 1]"
    obj = (
        f"'{{\"recommendation\": \"' || {rec} || '\", \"signal_score\": ' || (doc_id * 37 % 101) || "
        f"', \"fluff_score\": ' || (doc_id * 53 % 101) || ', \"technical_depth\": ' || (doc_id % 90) || "
        f"', \"novelty\": ' || (doc_id % 70) || ', \"relevance\": ' || (doc_id % 60) || ', \"summary\": \"' || {s} || "
        f"'\", \"why_selected\": \"Source ' || source || '\", \"technically_sound_claims\": [\"claim ' || doc_id || "
        f"'\", \"\"], \"marketing_or_hype\": [], \"claims_to_verify\": \"verify ' || lang || "
        f"'\", \"why_it_matters_to_me\": [\"  x  \", null, true, 3], \"skeptical_take\": null, \"suggested_action\": \"  act  \", \"tags\": [\"' || lang || '\", \"none called out.\"]}}'"
    )
    strings = (
        "'{\"recommendation\": \" Skim \", \"signal_score\": \"85\", \"fluff_score\": \" 12 \", \"technical_depth\": \"85.5\", "
        "\"novelty\": 85.9, \"relevance\": true, \"summary\": \"\", \"why_selected\": \"w' || doc_id || '\", \"tags\": []}'"
    )
    odd = (
        "'{\"recommendation\": \"BUY\", \"signal_score\": 150, \"fluff_score\": -5, \"technical_depth\": 99999999999, "
        f"\"novelty\": null, \"relevance\": [1], \"summary\": \"' || {s} || '\", \"tags\": \"single-tag\", \"claims_to_verify\": \"   \"}}'"
    )
    spin = q(C.SPINNER_FRAMES[:3] + " \n")
    return f"""model_outputs AS (
  SELECT doc_id, CASE doc_id % 12
    WHEN 0 THEN {obj}
    WHEN 1 THEN '```json' || chr(10) || {obj} || chr(10) || '```'
    WHEN 2 THEN {spin} || {obj}
    WHEN 3 THEN 'Here is my analysis: ' || {obj} || ' Hope this helps {{not json}}.'
    WHEN 4 THEN '{{"broken": ' || {obj}
    WHEN 5 THEN '```json' || chr(10) || '{{"recommendation": "read", "signal_score": }}' || chr(10) || '```'
    WHEN 6 THEN 'The model could not decide about ' || {s}
    WHEN 7 THEN {strings}
    WHEN 8 THEN {odd}
    WHEN 10 THEN '[1, 2] ' || {s}
    WHEN 11 THEN '```json' || chr(10) || '{{"recommendation": "read"}}, {{"recommendation": "skim"}}' || chr(10) || '```'
    ELSE NULL END AS raw
  FROM documents
)"""


def spinner(x: str) -> str:
    return f"regexp_replace({strip(x)}, {q('^[' + C.SPINNER_FRAMES + PY_WS_CLASS + ']+')}, '')"


PARSED = f"""parsed AS (
  SELECT doc_id, raw, cleaned, fenced,
    CASE WHEN raw IS NULL THEN NULL
         WHEN fenced <> '' THEN (CASE WHEN json_valid(fenced) THEN fenced END)
         ELSE found END AS obj,
    CASE WHEN raw IS NULL THEN 'Model output missing.'
         WHEN fenced <> '' AND NOT json_valid(fenced) THEN 'Could not parse model JSON: fenced JSON block is malformed'
         WHEN fenced = '' AND found IS NULL THEN 'Could not parse model JSON: No JSON object found' END AS error
  FROM (
    SELECT *, (list_filter(flatten(list_transform(opens, lambda p: list_transform(list_filter(closes, lambda c: c > p),
               lambda c: substring(cleaned, p, c - p + 1)))), lambda t: json_valid(t)))[1] AS found
    FROM (
      SELECT *, list_transform(range(1, len(string_split(cleaned, '{{'))), lambda i: length(array_to_string(string_split(cleaned, '{{')[1:i], '{{')) + 1) AS opens,
                list_transform(range(1, len(string_split(cleaned, '}}'))), lambda i: length(array_to_string(string_split(cleaned, '}}')[1:i], '}}')) + 1) AS closes
      FROM (SELECT doc_id, raw, {spinner('raw')} AS cleaned, regexp_extract({spinner('raw')}, {q(FENCE)}, 1) AS fenced FROM model_outputs)
    )
  )
)"""


def item_text(e: str) -> str:
    return (f"(CASE json_type({e}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN (CASE WHEN json_extract_string({e}, '$') = 'true' "
            f"THEN 'True' ELSE 'False' END) ELSE json_extract_string({e}, '$') END)")


def text_field(k: str) -> str:
    path = q("$." + k)
    return f"(CASE WHEN json_type(obj, {path}) IS NULL THEN '' ELSE {strip(item_text(f'json_extract(obj, {path})'))} END)"


def score(k: str) -> str:
    path = q("$." + k)
    v = f"json_extract_string(obj, {path})"
    ws = "[" + PY_WS_CLASS + "]*"
    raw = (f"(CASE json_type(obj, {path}) WHEN 'BIGINT' THEN TRY_CAST({v} AS BIGINT) WHEN 'UBIGINT' THEN TRY_CAST({v} AS BIGINT) "
           f"WHEN 'DOUBLE' THEN TRY_CAST(trunc(CAST({v} AS DOUBLE)) AS BIGINT) "
           f"WHEN 'BOOLEAN' THEN (CASE WHEN {v} = 'true' THEN 1 ELSE 0 END) "
           f"WHEN 'VARCHAR' THEN (CASE WHEN regexp_matches({v}, {q('^' + ws + '[+-]?[0-9]+' + ws + chr(92) + 'z')}) THEN TRY_CAST({strip(v)} AS BIGINT) END) END)")
    return f"CAST(least(100, greatest(0, coalesce({raw}, 0))) AS INTEGER)"


def string_list(k: str) -> str:
    path = q("$." + k)
    arr_path = q("$." + k + "[*]")
    s = strip(f"json_extract_string(obj, {path})")
    return (f"(CASE json_type(obj, {path}) WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(obj, {arr_path}), "
            f"lambda e: {strip(item_text('e'))}), lambda s: s <> '') "
            f"WHEN 'VARCHAR' THEN (CASE WHEN {s} <> '' THEN [{s}] ELSE []::VARCHAR[] END) ELSE []::VARCHAR[] END)")


def recommendation() -> str:
    r = f"lower({text_field('recommendation')})"
    return f"(CASE WHEN json_type(obj, '$.recommendation') IS NULL THEN 'watch' WHEN {r} IN ('read','skim','watch','ignore') THEN {r} ELSE 'watch' END)"


def analysis_cte() -> str:
    summary = text_field("summary")
    summary = f"(CASE WHEN {summary} = '' AND raw IS NOT NULL AND raw <> '' THEN substring({spinner('raw')}, 1, 500) ELSE {summary} END)"
    ok_cols = [f"{recommendation()} AS recommendation"]
    ok_cols += [f"{score(k)} AS {k}" for k in C.SCORE_FIELDS]
    ok_cols += [f"{summary} AS summary"] + [f"{text_field(k)} AS {k}" for k in C.TEXT_FIELDS[1:]]
    ok_cols += [f"{string_list(k)} AS {k}" for k in C.LIST_FIELDS]
    ok_cols += ["CAST(NULL AS VARCHAR) AS analysis_error"]
    err_cols = ["'ignore' AS recommendation"] + [f"0 AS {k}" for k in C.SCORE_FIELDS]
    err_cols += ["error AS summary", q(C.ERROR_WHY_SELECTED) + " AS why_selected", q(C.ERROR_SKEPTICAL_TAKE) + " AS skeptical_take",
                 q(C.ERROR_SUGGESTED_ACTION) + " AS suggested_action"]
    err_cols += ["[]::VARCHAR[] AS technically_sound_claims", "[]::VARCHAR[] AS marketing_or_hype", "[error] AS claims_to_verify",
                 "[]::VARCHAR[] AS why_it_matters_to_me", f"[{q(C.ERROR_TAG)}] AS tags", "error AS analysis_error"]
    cols = ["recommendation", *C.SCORE_FIELDS, *C.TEXT_FIELDS, *C.LIST_FIELDS, "analysis_error"]
    return f"""analysis AS (
  SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, {', '.join(ok_cols)} FROM parsed WHERE obj IS NOT NULL)
  UNION ALL
  SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, {', '.join(err_cols)} FROM parsed WHERE obj IS NULL)
)"""


def _w(*extra: str) -> str:
    return "WITH " + ",\n".join([model_outputs_cte(), PARSED, *extra]) + "\n"


J = lambda k: f"array_to_string({k}, '||') AS {k}"

ANALYSIS_SELECT = ", ".join(["doc_id", "recommendation", *C.SCORE_FIELDS, *C.TEXT_FIELDS, *[J(k) for k in C.LIST_FIELDS], "analysis_error"])

RESP_SAFE_HEAD = f"regexp_replace(text, {q(SAFE)}, ' ', 'g')"
RESPONSES = f"""responses AS (
  SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN 'Sure, here you go:' || chr(10) || '```json' || chr(10) || arr || chr(10) || '```' || chr(10) || 'Enjoy.'
    WHEN 1 THEN arr
    ELSE 'Sorry, nothing found about ' || s END AS response
  FROM (SELECT doc_id, s, '[{{"title": "T' || doc_id || '", "url": "https://example.org/' || lang || '/' || doc_id || '", "content": "' || s
               || '"}}, {{"title": "' || lang || '", "url": "", "content": ""}}]' AS arr
        FROM (SELECT doc_id, lang, {RESP_SAFE_HEAD} AS s FROM documents))
),
bodies AS (
  SELECT doc_id, CASE WHEN regexp_extract(response, {q(r'(?is)(```(?:json)?' + chr(10) + '.*?```)')}, 1) <> ''
                      THEN regexp_extract(response, {q(r'(?is)```(?:json)?' + chr(10) + '(.*?)```')}, 1) ELSE response END AS body
  FROM responses
)"""

SQL = {
    "strip_spinner": "WITH " + model_outputs_cte() + f"\nSELECT doc_id, {spinner('raw')} AS cleaned FROM model_outputs",
    "json_object_extract": _w() + "SELECT doc_id, obj IS NOT NULL AS found, error, json_extract_string(obj, '$.recommendation') AS recommendation_raw FROM parsed",
    "clamp_score": _w(analysis_cte()) + f"SELECT doc_id, {', '.join(C.SCORE_FIELDS)} FROM analysis",
    "string_list": _w(analysis_cte()) + f"SELECT doc_id, {', '.join(J(k) for k in C.LIST_FIELDS)} FROM analysis",
    "analysis_normalize": _w(analysis_cte()) + f"SELECT {ANALYSIS_SELECT} FROM analysis",
    "analysis_error_route": _w(analysis_cte()) + "SELECT doc_id, analysis_error IS NOT NULL AS is_error, analysis_error, recommendation, why_selected, "
    + J("claims_to_verify") + ", " + J("tags") + " FROM analysis",
    "response_array_explode": "WITH " + RESPONSES + """
SELECT doc_id, CAST(i AS INTEGER) AS idx, json_extract_string(items[i + 1], '$.title') AS title,
       json_extract_string(items[i + 1], '$.url') AS url, json_extract_string(items[i + 1], '$.content') AS content, true AS ok
FROM (SELECT doc_id, json_extract(body, '$[*]') AS items FROM bodies WHERE (CASE WHEN json_valid(body) THEN json_type(body) END) = 'ARRAY'),
     LATERAL (SELECT unnest(range(len(items))) AS i)
UNION ALL
SELECT doc_id, NULL, NULL, NULL, NULL, false FROM bodies WHERE (CASE WHEN json_valid(body) THEN json_type(body) END) IS DISTINCT FROM 'ARRAY'""",
}

SQL["analysis_join"] = (
    _with(*CANDS).rstrip() + ",\n" + ",\n".join([model_outputs_cte(), PARSED, analysis_cte()]) + """,
top AS (
  SELECT CAST(row_number() OVER (ORDER BY (rn_in_source > 1), discovery_score DESC, first_pos) AS INTEGER) AS rank, url, pos
  FROM ranked ORDER BY (rn_in_source > 1), discovery_score DESC, first_pos LIMIT 30
)
SELECT t.rank, t.url, coalesce(a.recommendation, 'ignore') AS recommendation, coalesce(a.signal_score, 0) AS signal_score,
       CASE WHEN a.doc_id IS NULL THEN 'Model output missing.' ELSE a.analysis_error END AS analysis_error
FROM top t LEFT JOIN (SELECT * FROM analysis WHERE doc_id % 7 <> 3) a ON a.doc_id = t.pos"""
)
