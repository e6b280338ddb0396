"""DuckDB oracle SQL for the discovery queries."""

from __future__ import annotations

from oracle.common import (AS_OF, TOPIC, entry_text, fixture_ctes, haystack, iso, norm_url, q, recency_bonus, strip,
                           topic_score, weight_bonus)

HAY = haystack(entry_text("title", "summary", "terms"), "f.tags")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([fixture_ctes().strip(), *ctes]) + "\n"


CANDS = [
    f"e1 AS (SELECT *, {norm_url('link')} AS url FROM entries WHERE link IS NOT NULL AND link <> '')",
    "e2 AS (SELECT * FROM e1 WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.url = e1.url))",
    f"e3 AS (SELECT * REPLACE (coalesce(published, updated) AS published) FROM e2 "
    f"WHERE coalesce(published, updated) IS NULL OR coalesce(published, updated) >= {AS_OF} - INTERVAL 14 DAY)",
    f"cands AS (SELECT e3.pos, e3.url, {strip('coalesce(e3.title, e3.url)')} AS title, "
    f"{strip('coalesce(e3.summary, ' + q('') + ')')} AS content, coalesce(e3.source, 'unknown') AS source, 'feed' AS source_type, "
    f"{iso('e3.published')} AS published, coalesce(f.tags, []::VARCHAR[]) AS tags, "
    f"CAST({topic_score(TOPIC, HAY)} + {weight_bonus('f.weight')} + {recency_bonus('e3.published')} AS INTEGER) AS discovery_score "
    f"FROM e3 JOIN feeds f ON f.name = e3.source)",
    "best AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY discovery_score DESC, pos) AS rk, "
    "min(pos) OVER (PARTITION BY url) AS first_pos FROM cands) WHERE rk = 1)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY discovery_score DESC, first_pos) AS rn_in_source FROM best)",
]


def _topk(cap: int, limit: int) -> str:
    k = max(limit, 1)
    return _with(*CANDS) + f"""
SELECT CAST(row_number() OVER (ORDER BY (rn_in_source > {cap}), discovery_score DESC, first_pos) AS INTEGER) AS rank,
       url, title, source, published, discovery_score
FROM ranked
ORDER BY (rn_in_source > {cap}), discovery_score DESC, first_pos
LIMIT {k}"""


TOPICS = [TOPIC, "Kubernetes operations", "security for AI systems"]


def _topk_topics(cap: int, limit: int) -> str:
    one = _topk(cap, limit)
    parts = [f"SELECT {q(t)} AS topic, * FROM ({one.replace(topic_score(TOPIC, HAY), topic_score(t, HAY))})" for t in TOPICS]
    return "\nUNION ALL\n".join(parts)


TRIMMED = "regexp_replace({}, '^[\\x{{0}}-\\x{{20}}]+|[\\x{{0}}-\\x{{20}}]+\\z', '', 'g')"  # XML text nodes lose blanks at both ends
LANDED = """two AS (
  SELECT 2 * i + odd AS feed_id, name, odd,
         ([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.29::DOUBLE])[((i + odd) % 5) + 1] AS weight,
         ([['ai','llm'], ['devops','cloud'], ['data'], []::VARCHAR[]])[((i + odd) % 4) + 1] AS tags
  FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT source AS name FROM documents)), (VALUES (0), (1)) o(odd)
),
landed AS (
  SELECT two.feed_id, row_number() OVER (PARTITION BY two.feed_id ORDER BY pos) AS entry_no,
         CASE WHEN odd = 0 THEN 'rss' ELSE 'atom' END AS kind, source, link, TITLE AS title, SUMMARY AS summary, terms,
         coalesce(published, updated) AS published, NULL::TIMESTAMP AS updated, weight, tags
  FROM entries e JOIN two ON two.name = e.source AND two.odd = e.pos % 2
)""".replace("TITLE", TRIMMED.format("title")).replace("SUMMARY", TRIMMED.format("summary"))
LANDED_TOP = [
    LANDED,
    CANDS[0].replace("FROM entries", "FROM (SELECT *, feed_id * 1099511627776 + entry_no AS pos FROM landed)"),
    CANDS[1], CANDS[2],
    CANDS[3].replace("JOIN feeds f ON f.name = e3.source", "JOIN two f ON f.feed_id = e3.feed_id"),
    *CANDS[4:],
]


SQL = {
    "landed_feeds": _with(LANDED) + f"""
SELECT feed_id, entry_no, kind, source, link, title, CAST(length(summary) AS INTEGER) AS summary_chars, array_to_string(terms, ',') AS terms,
       {iso('published')} AS published, weight, array_to_string(tags, ',') AS tags
FROM landed WHERE link <> ''""",
    "landed_feeds_topk": _with(*LANDED_TOP) + """
SELECT CAST(row_number() OVER (ORDER BY (rn_in_source > 1), discovery_score DESC, first_pos) AS INTEGER) AS rank,
       url, title, source, published, array_to_string(tags, ',') AS tags, discovery_score
FROM ranked ORDER BY (rn_in_source > 1), discovery_score DESC, first_pos LIMIT 30""",
    "normalize_url": f"SELECT page_id, url, {norm_url('url')} AS norm_url FROM pages",
    "entry_published": _with() + f"SELECT pos, {iso('coalesce(published, updated)')} AS published FROM entries",
    "recency_filter": _with() + f"""
SELECT pos, strftime(coalesce(published, updated), '%Y-%m-%d %H:%M:%S') AS published FROM entries
WHERE coalesce(published, updated) IS NULL OR coalesce(published, updated) >= {AS_OF} - INTERVAL 14 DAY""",
    "entry_text": _with() + f"SELECT pos, {entry_text('title', 'summary', 'terms')} AS text FROM entries",
    "topic_tokens": """
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9.+#-]+'), lambda w: length(w) > 2) AS toks FROM documents)""",
    "feed_entry_enrich": _with() + "SELECT e.pos, e.source, f.weight, array_to_string(f.tags, ',') AS tags FROM entries e JOIN feeds f ON f.name = e.source",
    "keyword_hits": _with() + f"""
SELECT pos, category, keyword FROM (
  SELECT e.pos, {HAY} AS hay FROM entries e JOIN feeds f ON f.name = e.source
) JOIN (SELECT * FROM (VALUES {{KW}}) AS t(category, keyword)) kw ON contains(hay, kw.keyword)""",
    "topic_score": _with() + f"SELECT e.pos, {topic_score(TOPIC, HAY)} AS topic_score FROM entries e JOIN feeds f ON f.name = e.source",
    "discovery_score": _with(*CANDS[:1]) + f""",
d AS (SELECT * REPLACE (coalesce(published, updated) AS published) FROM e1
      WHERE coalesce(published, updated) IS NULL OR coalesce(published, updated) >= {AS_OF} - INTERVAL 14 DAY)
SELECT d.pos, d.url,
  {topic_score(TOPIC, HAY.replace('title', 'd.title').replace('summary', 'd.summary').replace('terms', 'd.terms'))} AS topic_score,
  {weight_bonus('f.weight')} AS weight_bonus,
  CAST({recency_bonus('d.published')} AS INTEGER) AS recency_bonus,
  CAST({topic_score(TOPIC, HAY.replace('title', 'd.title').replace('summary', 'd.summary').replace('terms', 'd.terms'))} + {weight_bonus('f.weight')} + {recency_bonus('d.published')} AS INTEGER) AS discovery_score
FROM d JOIN feeds f ON f.name = d.source""",
    "seen_suppress": _with(*CANDS[:2]) + "SELECT pos, url FROM e2",
    "candidate_build": _with(*CANDS) + "SELECT pos, title, url, content, source, source_type, published, array_to_string(tags, ',') AS tags, discovery_score FROM cands",
    "url_dedup_best": _with(*CANDS) + "SELECT url, first_pos, pos, source, discovery_score FROM best",
    "rank_within_source": _with(*CANDS) + "SELECT url, source, discovery_score, first_pos, CAST(rn_in_source AS INTEGER) AS rn_in_source FROM ranked",
    "capped_topk": _topk(2, 6),
    "capped_topk_backfill": _topk(1, 30),
    "capped_topk_topics": _topk_topics(1, 30),
}


def _kw_values() -> str:
    from oracle.common import active_keywords
    from gleaner.functions import constants as C

    t = TOPIC.lower()
    rows = [f"({q(cat)}, {q(kw)})" for cat, kws in C.TOPIC_KEYWORDS.items() if cat in t for kw in kws]
    assert len(rows) == len(active_keywords(TOPIC))
    return ", ".join(rows)


SQL["keyword_hits"] = SQL["keyword_hits"].replace("{KW}", _kw_values())
