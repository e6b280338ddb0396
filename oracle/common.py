"""DuckDB building blocks for the oracle SQL (independent of the Spark code path).

Each helper returns DuckDB SQL text. Patterns use the regex subset shared by
RE2 and Java, so both engines read them the same way.
"""

from __future__ import annotations

from gleaner.functions import constants as C

PY_WS_CLASS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
PY_WS = "[" + PY_WS_CLASS + "]"
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TOPIC = "AI agents for data and devops"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + PY_WS + '+|' + PY_WS + '+' + chr(92) + 'z')}, '', 'g')"


def pct_decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def quote_plus(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def norm_url(x: str) -> str:
    s = strip(x)
    s = f"regexp_replace({s}, '[\\t\\r\\n]', '', 'g')"
    s = f"regexp_replace({s}, {q(r'^[\x{0}-\x{20}]+')}, '')"
    scheme = f"lower(regexp_extract({s}, {q(URL_RE)}, 1))"
    auth = f"regexp_extract({s}, {q(URL_RE)}, 2)"
    netloc = f"lower(substring({auth}, 3))"
    raw_path = f"regexp_extract({s}, {q(URL_RE)}, 3)"
    query = f"regexp_extract({s}, {q(URL_RE)}, 4)"
    path1 = f"(CASE WHEN list_contains({lst(C.SCHEMES_WITH_PARAMS)}, {scheme}) THEN regexp_replace({raw_path}, {q(';[^/]*' + chr(92) + 'z')}, '') ELSE {raw_path} END)"
    stripped = f"regexp_replace({path1}, {q('/+' + chr(92) + 'z')}, '')"
    path = f"(CASE WHEN {stripped} = '' THEN {path1} ELSE {stripped} END)"
    body = (
        f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || (CASE WHEN {path} = '' OR starts_with({path}, '/') THEN {path} ELSE '/' || {path} END)"
        f" WHEN starts_with({path}, '//') THEN '//' || {path}"
        f" WHEN {scheme} <> '' AND list_contains({lst(C.SCHEMES_WITH_NETLOC)}, {scheme}) AND ({path} = '' OR starts_with({path}, '/')) THEN '//' || {path}"
        f" ELSE {path} END)"
    )
    parts = f"list_filter(string_split({query}, '&'), lambda p: p <> '')"
    kv = (
        f"list_transform({parts}, lambda p: {{'k': {pct_decode('CASE WHEN strpos(p, ' + q('=') + ') > 0 THEN split_part(p, ' + q('=') + ', 1) ELSE p END')}, "
        f"'v': {pct_decode('CASE WHEN strpos(p, ' + q('=') + ') > 0 THEN substring(p, strpos(p, ' + q('=') + ') + 1) ELSE ' + q('') + ' END')}}})"
    )
    kept = f"list_filter({kv}, lambda e: NOT list_contains({lst(C.TRACKING_PARAMS)}, lower(e.k)))"
    qry = f"array_to_string(list_transform({kept}, lambda e: {quote_plus('e.k')} || '=' || {quote_plus('e.v')}), '&')"
    out = f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || {body} || (CASE WHEN {qry} <> '' THEN '?' || {qry} ELSE '' END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {out} END)"


def fixture_ctes() -> str:
    """feeds, entries, seen: the FIXTURES.md derived views."""
    return f"""
feeds AS (
  SELECT name,
         ([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.29::DOUBLE])[(i % 5) + 1] AS weight,
         ([['ai','llm'], ['devops','cloud'], ['data'], []::VARCHAR[]])[(i % 4) + 1] AS tags
  FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT source AS name FROM documents))
),
entries AS (
  SELECT d.doc_id AS pos, d.source,
         CASE WHEN d.doc_id % 50 = 49 THEN '' ELSE p.url END AS link,
         d.source || ' entry ' || d.doc_id AS title,
         d.text AS summary,
         [d.lang] AS terms,
         CASE WHEN d.doc_id % 11 = 10 THEN NULL ELSE date_trunc('second', e.ts) END AS published,
         CASE WHEN d.doc_id % 22 = 10 THEN date_trunc('second', e.ts) ELSE NULL END AS updated
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN events e ON e.event_id = (d.doc_id * 7919) % (SELECT count(*) FROM events)
),
seen AS (
  SELECT {norm_url('url')} AS url FROM pages WHERE page_id % 5 = 0
)"""


def topic_words(topic: str) -> list[str]:
    import re

    return [w for w in re.split(C.TOPIC_SPLIT_PATTERN, topic.lower()) if len(w) > 2]


def active_keywords(topic: str) -> list[str]:
    t = topic.lower()
    return [kw for cat, kws in C.TOPIC_KEYWORDS.items() if cat in t for kw in kws]


def topic_score(topic: str, hay: str) -> str:
    terms = [f"(CASE WHEN contains({hay}, {q(w)}) THEN 8 ELSE 0 END)" for w in topic_words(topic)]
    terms += [f"(CASE WHEN contains({hay}, {q(k)}) THEN 5 ELSE 0 END)" for k in active_keywords(topic)]
    return "CAST((" + (" + ".join(terms) or "0") + ") AS INTEGER)"


def entry_text(title: str, summary: str, terms: str) -> str:
    return f"array_to_string(list_filter(list_concat([{title}, {summary}], coalesce({terms}, []::VARCHAR[])), lambda x: x IS NOT NULL AND x <> ''), chr(10))"


def haystack(text: str, tags: str) -> str:
    return f"lower({text} || chr(10) || array_to_string(coalesce({tags}, []::VARCHAR[]), ' '))"


def iso(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00', '')"


def weight_bonus(w: str) -> str:
    return f"CAST(trunc(coalesce({w}, 0.5) * 10) AS INTEGER)"


def recency_bonus(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL THEN 0 ELSE greatest(0, 14 - greatest(0, CAST((epoch_us({AS_OF}) - epoch_us({p})) // 86400000000 AS INTEGER))) END)"
