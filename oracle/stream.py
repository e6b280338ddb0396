"""DuckDB oracle SQL for the streaming queries (a finished stream equals the batch result)."""

from __future__ import annotations

from oracle.common import AS_OF, norm_url
from oracle.discovery import CANDS, SQL as DISCOVERY, _with
from oracle.state import _top

SQL = {
    "stream_recency": DISCOVERY["recency_filter"],
    "stream_url_dedup": "WITH " + DISCOVERY["entry_text"].split("WITH ", 1)[1].split("\nSELECT pos,")[0]
    + f"\nSELECT DISTINCT {norm_url('link')} AS url FROM entries WHERE link IS NOT NULL AND link <> ''",
    "stream_daily_volume": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_seen_upsert": _top(CANDS, 2, 6) + f"""
, batch AS (SELECT url, arg_max({{'title': title, 'source': source, 'published': published}}, rank) AS b FROM top GROUP BY url)
SELECT coalesce(s.url, n.url) AS url,
       strftime(CASE WHEN s.url IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE {AS_OF} END, '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(CASE WHEN n.url IS NOT NULL THEN {AS_OF} ELSE TIMESTAMP '2024-01-10 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS last_seen,
       CASE WHEN n.url IS NOT NULL THEN n.b.title ELSE '' END AS title,
       CASE WHEN n.url IS NOT NULL THEN n.b.source ELSE '' END AS source,
       CASE WHEN n.url IS NOT NULL THEN n.b.published ELSE '' END AS published
FROM seen s FULL OUTER JOIN batch n ON s.url = n.url""",
}

# the best row of every url; a closed day ends a day before the newest event, whose window is still open
SQL["stream_url_best"] = _with(*CANDS) + "SELECT url, first_pos, pos, source, discovery_score, title FROM best"
SQL["stream_seen_buckets"] = SQL["stream_seen_upsert"]
SQL["stream_closed_days"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2"""
