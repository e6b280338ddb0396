"""DuckDB oracle SQL for state, envelope, union and source queries."""

from __future__ import annotations

from oracle.analysis import RESPONSES
from oracle.common import AS_OF, TOPIC, q, strip
from oracle.discovery import CANDS, _with

RECENT = """recent AS (
  SELECT user_id, event_id, event_type AS topic,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent_rank
  FROM events QUALIFY recent_rank <= 5
)"""

# candidates without seen suppression (include_seen = true)
CANDS_ALL = [CANDS[0], "e2 AS (SELECT * FROM e1)", *CANDS[2:]]


def _top(cands: list[str], cap: int, limit: int) -> str:
    return _with(*cands).rstrip() + f""",
top AS (
  SELECT CAST(row_number() OVER (ORDER BY (rn_in_source > {cap}), discovery_score DESC, first_pos) AS INTEGER) AS rank, *
  FROM ranked ORDER BY (rn_in_source > {cap}), discovery_score DESC, first_pos LIMIT {limit}
)
"""


SEEN_UPSERT = _top(CANDS_ALL, 1, 30) + f"""
, batch AS (SELECT url, arg_max({{'title': title, 'source': source, 'published': published}}, rank) AS b FROM top GROUP BY url)
SELECT coalesce(s.url, n.url) AS url,
       strftime(coalesce(TIMESTAMP '2024-01-01 00:00:00', {AS_OF}), '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(CASE WHEN n.url IS NOT NULL THEN {AS_OF} ELSE TIMESTAMP '2024-01-10 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS last_seen,
       CASE WHEN n.url IS NOT NULL THEN n.b.title ELSE '' END AS title,
       CASE WHEN n.url IS NOT NULL THEN n.b.source ELSE '' END AS source,
       CASE WHEN n.url IS NOT NULL THEN n.b.published ELSE '' END AS published
FROM seen s FULL OUTER JOIN batch n ON s.url = n.url"""
# rows only in the batch get first_seen = as_of
SEEN_UPSERT = SEEN_UPSERT.replace(
    "strftime(coalesce(TIMESTAMP '2024-01-01 00:00:00', " + AS_OF + "), '%Y-%m-%d %H:%M:%S') AS first_seen",
    "strftime(CASE WHEN s.url IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE " + AS_OF + " END, '%Y-%m-%d %H:%M:%S') AS first_seen",
)

ENVELOPE = _top(CANDS, 2, 6) + f"""
, env AS (
  SELECT {q(TOPIC)} AS topic, count(*) AS n_articles,
         list({{'title': title, 'url': url, 'content': content, 'source': source, 'source_type': source_type, 'published': published,
                'tags': tags, 'discovery_score': discovery_score}} ORDER BY rank) AS articles
  FROM top
)
"""

SQL = {
    "recent_tail": "WITH " + RECENT + "\nSELECT user_id, event_id, topic, CAST(recent_rank AS INTEGER) AS recent_rank FROM recent",
    "topic_rotation": "WITH " + RECENT + """,
topics AS (SELECT DISTINCT event_type AS topic FROM events),
users AS (SELECT DISTINCT user_id FROM recent),
unused AS (
  SELECT u.user_id, t.topic, md5(t.topic || '2024-01-31') AS h FROM users u, topics t
  WHERE t.topic NOT IN (SELECT r.topic FROM recent r WHERE r.user_id = u.user_id)
),
firstall AS (SELECT topic FROM topics ORDER BY md5(topic || '2024-01-31'), topic LIMIT 1)
SELECT u.user_id, coalesce((SELECT x.topic FROM unused x WHERE x.user_id = u.user_id ORDER BY x.h, x.topic LIMIT 1),
                           (SELECT topic FROM firstall)) AS topic
FROM users u""",
    "seen_upsert": SEEN_UPSERT,
    "envelope_build": ENVELOPE + """SELECT topic, CAST(n_articles AS INTEGER) AS n_articles,
  CAST(to_json({'topic': topic, 'source_mode': 'feeds', 'articles': articles}) AS VARCHAR) AS envelope FROM env""",
    "envelope_explode": _top(CANDS, 2, 6) + f"""SELECT {q(TOPIC)} AS topic, 'feeds' AS source_mode, CAST(rank - 1 AS INTEGER) AS pos, url, title, discovery_score FROM top""",
    "candidate_union": _with(*CANDS[:4]).rstrip() + ",\n" + RESPONSES + """
SELECT 'feeds' AS mode, url, title, source, source_type, discovery_score FROM cands
UNION ALL
SELECT 'search', json_extract_string(items[i + 1], '$.url'), json_extract_string(items[i + 1], '$.title'), NULL, NULL, NULL
FROM (SELECT doc_id, json_extract(body, '$[*]') AS items FROM bodies WHERE (CASE WHEN json_valid(body) THEN json_type(body) END) = 'ARRAY'),
     LATERAL (SELECT unnest(range(len(items))) AS i)""",
    "seen_state_scan": _with() + """SELECT url, '2024-01-01T00:00:00+00:00' AS first_seen, '2024-01-10T00:00:00+00:00' AS last_seen, '' AS title FROM seen""",
    "feed_entry_scan": _with() + """SELECT pos, source, link, JTRIM(title) AS title, CAST(length(JTRIM(summary)) AS INTEGER) AS summary_chars, array_to_string(terms, ',') AS terms,
  strftime(coalesce(published, updated), '%Y-%m-%d %H:%M:%S') AS published FROM entries WHERE link <> ''""",
}
_ = strip
# XML text nodes lose surrounding characters <= U+0020 (Java String.trim)
SQL["feed_entry_scan"] = SQL["feed_entry_scan"].replace("JTRIM(title)", "regexp_replace(title, '^[\\x{0}-\\x{20}]+|[\\x{0}-\\x{20}]+\\z', '', 'g')").replace(
    "JTRIM(summary)", "regexp_replace(summary, '^[\\x{0}-\\x{20}]+|[\\x{0}-\\x{20}]+\\z', '', 'g')")
