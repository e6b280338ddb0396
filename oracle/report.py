"""DuckDB oracle SQL for the report queries."""

from __future__ import annotations

from gleaner.functions import constants as C
from oracle.common import lst, q, strip

SEP = "'||'"
GENERATED_AT = "2024-01-31T00:00:00"
MODEL = "local-model"

MISSING = q('Model output missing.')
ANALYSED = f"""analysed AS (
  SELECT d.lang AS topic, d.doc_id AS pos,
    d.source || ' article ' || d.doc_id AS title,
    p.url, d.text AS content,
    CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE d.source END AS source,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE coalesce(strftime(date_trunc('second', e.ts), '%Y-%m-%dT%H:%M:%S') || '+00:00', '') END AS published,
    CASE WHEN l.quality = 1 THEN '{C.CONTENT_SOURCE_EXTRACTED}' ELSE '{C.CONTENT_SOURCE_FALLBACK}' END AS content_source,
    'site-' || d.lang AS site_name,
    '2024-01-0' || (d.doc_id % 9 + 1) AS published_date,
    CASE WHEN l.quality = 1 THEN 'ok' ELSE 'too-short' END AS status,
    CAST(d.n_chars AS INTEGER) AS content_chars,
    CASE WHEN l.doc_id IS NULL THEN 'ignore' ELSE ((['read','skim','watch','ignore'])[((d.doc_id * 7 + l.quality) % 4) + 1]) END AS recommendation,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE (CAST(d.doc_id * 37 % 101 AS INTEGER)) END AS signal_score,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE (CAST(d.doc_id * 53 % 101 AS INTEGER)) END AS fluff_score,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE (CAST(d.doc_id * 11 % 101 AS INTEGER)) END AS technical_depth,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE (CAST(d.doc_id * 13 % 101 AS INTEGER)) END AS novelty,
    CASE WHEN l.doc_id IS NULL THEN 0 ELSE (CAST(d.doc_id * 17 % 101 AS INTEGER)) END AS relevance,
    CASE WHEN l.doc_id IS NULL THEN {MISSING} ELSE (CASE WHEN d.doc_id % 9 = 0 THEN '' WHEN d.doc_id % 9 = 1 THEN 'Not specified.' ELSE d.text END) END AS summary,
    CASE WHEN l.doc_id IS NULL THEN {q(C.ERROR_WHY_SELECTED)} ELSE (CASE WHEN d.doc_id % 7 = 0 THEN 'none called out.' ELSE 'Matches ' || d.lang END) END AS why_selected,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE (['claim ' || d.doc_id, 'Not specified.']) END AS technically_sound_claims,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE (CASE WHEN l.toxic = 1 THEN ['hype ' || d.doc_id] ELSE []::VARCHAR[] END) END AS marketing_or_hype,
    CASE WHEN l.doc_id IS NULL THEN [{MISSING}] ELSE (['']) END AS claims_to_verify,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE (['matters to ' || d.lang]) END AS why_it_matters_to_me,
    CASE WHEN l.doc_id IS NULL THEN {q(C.ERROR_SKEPTICAL_TAKE)} ELSE (CASE WHEN l.toxic = 1 THEN 'No skeptical take produced.' ELSE 'Check claims about ' || d.source END) END AS skeptical_take,
    CASE WHEN l.doc_id IS NULL THEN {q(C.ERROR_SUGGESTED_ACTION)} ELSE (CASE WHEN l.quality = 0 THEN 'No action suggested.' ELSE 'Read the source' END) END AS suggested_action,
    CASE WHEN l.doc_id IS NULL THEN [{q(C.ERROR_TAG)}] ELSE ([d.lang, '', 'none called out.', d.source]) END AS tags,
    CASE WHEN l.doc_id IS NULL THEN {MISSING} ELSE (CASE WHEN d.doc_id % 13 = 0 THEN 'Could not parse model JSON' END) END AS analysis_error,
    CASE WHEN l.doc_id IS NULL THEN 3 ELSE (CASE (['read','skim','watch','ignore'])[((d.doc_id * 7 + l.quality) % 4) + 1] WHEN 'read' THEN 0 WHEN 'skim' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END) END AS rec_order
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN events e ON e.event_id = (d.doc_id * 7919) % (SELECT count(*) FROM events)
),
topics AS (SELECT DISTINCT lang AS topic FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rec_order, signal_score DESC, fluff_score, pos) AS digest_rank,
         CASE WHEN recommendation <> 'ignore' THEN 'kept' ELSE 'ignored' END AS section
  FROM analysed
),
sectioned AS (SELECT *, row_number() OVER (PARTITION BY topic, section ORDER BY digest_rank) AS section_rank FROM ranked)"""


def meaningful(x: str) -> str:
    return f"({x} IS NOT NULL AND lower({strip(x)}) NOT IN ({', '.join(q(v) for v in C.EMPTY_FIELD_VALUES)}))"


def items(x: str) -> str:
    return f"list_filter(coalesce({x}, []::VARCHAR[]), lambda t: {meaningful('t')})"


def keep(x: str) -> str:
    return f"(CASE WHEN {meaningful(x)} THEN {x} ELSE '' END)"


CARDS = f"""cards AS (
  SELECT *, upper(lower(recommendation)) AS badge, coalesce(title, 'Untitled') AS card_title,
    coalesce(nullif(source, ''), nullif(site_name, ''), 'unknown source') AS display_source,
    substring(coalesce(nullif(published, ''), nullif(published_date, ''), ''), 1, 10) AS display_published,
    coalesce(content_source, 'unknown') AS card_content_source, coalesce(status, 'unknown') AS card_status,
    CASE WHEN {meaningful('summary')} THEN summary ELSE '{C.NO_SUMMARY_TEXT}' END AS card_summary,
    {keep('skeptical_take')} AS card_take, {keep('suggested_action')} AS card_action, {keep('why_selected')} AS card_why,
    {items('tags')} AS card_tags, coalesce(analysis_error, '') AS card_error,
    {items('technically_sound_claims')} AS card_technically_sound_claims,
    {items('marketing_or_hype')} AS card_marketing_or_hype,
    {items('claims_to_verify')} AS card_claims_to_verify,
    {items('why_it_matters_to_me')} AS card_why_it_matters_to_me
  FROM sectioned
),
card_text AS (
  SELECT *, list_filter([
      '## [' || badge || '] ' || card_title,
      concat_ws(' · ', display_source, CASE WHEN display_published <> '' THEN display_published END,
                'content: ' || card_content_source, 'extraction: ' || card_status),
      'Signal ' || signal_score || ' · Fluff ' || fluff_score || ' · Depth ' || technical_depth || ' · Novelty ' || novelty || ' · Relevance ' || relevance,
      card_summary,
      CASE WHEN card_take <> '' THEN 'Skeptical take: ' || card_take END,
      CASE WHEN card_action <> '' THEN 'Suggested action: ' || card_action END,
      CASE WHEN card_why <> '' THEN 'Why selected: ' || card_why END,
      CASE WHEN len(card_tags) > 0 THEN 'Tags: ' || array_to_string(card_tags, ', ') END,
      CASE WHEN card_error <> '' THEN 'Analysis error: ' || card_error END,
      CASE WHEN len(card_technically_sound_claims) > 0 THEN 'Technically sound claims: ' || array_to_string(card_technically_sound_claims, '; ') END,
      CASE WHEN len(card_marketing_or_hype) > 0 THEN 'Marketing / hype / weak spots: ' || array_to_string(card_marketing_or_hype, '; ') END,
      CASE WHEN len(card_claims_to_verify) > 0 THEN 'Claims to verify: ' || array_to_string(card_claims_to_verify, '; ') END,
      CASE WHEN len(card_why_it_matters_to_me) > 0 THEN 'Why it may matter to me: ' || array_to_string(card_why_it_matters_to_me, '; ') END,
      CASE WHEN coalesce(url, '') <> '' THEN 'Read source: ' || url END,
      ''], lambda x: x IS NOT NULL) AS lines
  FROM cards
)"""


def lines_of(src: str, block: int, item: str, arr: str, where: str = "TRUE") -> str:
    return (f"SELECT topic, {block} AS block, CAST({item} AS BIGINT) AS item, CAST(unnest(range(len({arr}))) AS INTEGER) AS line, "
            f"unnest({arr}) AS text FROM {src} WHERE {where}")


HEADER = ("['# 🔍 Topic: ' || topic, '', 'Generated: " + GENERATED_AT + "', 'Model: `" + MODEL + "`', 'Model timeout: `300s`', '', "
          + q(C.DIGEST_INTRO) + ", '']")

TOPLINE = """topline AS (
  SELECT t.topic, b.best_title, c.counts_line FROM topics t
  LEFT JOIN (SELECT topic, coalesce(title, 'Untitled') AS best_title FROM ranked WHERE digest_rank = 1) b ON b.topic = t.topic
  LEFT JOIN (SELECT topic, 'Today: ' || count(*) FILTER (WHERE recommendation = 'read') || ' read, ' || count(*) FILTER (WHERE recommendation = 'skim')
             || ' skim, ' || count(*) FILTER (WHERE recommendation = 'watch') || ' watch, ' || count(*) FILTER (WHERE recommendation = 'ignore')
             || ' ignore.' AS counts_line FROM analysed GROUP BY topic) c ON c.topic = t.topic
)"""

REPORT = "WITH " + ANALYSED + ",\n" + CARDS + ",\n" + TOPLINE + f""",
kept_n AS (SELECT t.topic, k.n FROM topics t LEFT JOIN (SELECT topic, count(*) AS n FROM analysed WHERE recommendation <> 'ignore' GROUP BY topic) k ON k.topic = t.topic),
ign AS (SELECT DISTINCT topic FROM analysed WHERE recommendation = 'ignore')
{lines_of('topics', 0, '0', HEADER)}
UNION ALL {lines_of('topline', 1, '0', "[counts_line, 'Best candidate: ' || best_title, '']", 'best_title IS NOT NULL')}
UNION ALL {lines_of('kept_n', 2, '0', "['# Worth attention', '']", 'n IS NOT NULL')}
UNION ALL {lines_of('kept_n', 2, '0', "['# Worth attention', '', " + q(C.NO_ARTICLES_TEXT) + ", '']", 'n IS NULL')}
UNION ALL {lines_of('card_text', 3, 'section_rank', 'lines', "section = 'kept'")}
UNION ALL {lines_of('ign', 4, '0', "['# Rejected / low signal', '']")}
UNION ALL {lines_of('card_text', 5, 'section_rank', 'lines', "section = 'ignored'")}"""

MANUAL_HEADER = ("['# Manual article analysis: manual URL review', '', 'Generated: " + GENERATED_AT + "', 'Model: `" + MODEL + "`', '', "
                 + q(C.MANUAL_INTRO) + ", '']")

MANUAL = ("WITH " + ANALYSED.replace("FROM analysed\n),\nsectioned", "FROM analysed\n),\nsectioned") + ",\n"
          + CARDS.replace("FROM sectioned", "FROM (SELECT * REPLACE (url AS title, 'manual URL review' AS topic) FROM sectioned)") + f"""
SELECT 'manual URL review' AS topic, 0 AS block, CAST(0 AS BIGINT) AS item, CAST(unnest(range(len(h))) AS INTEGER) AS line, unnest(h) AS text
FROM (SELECT {MANUAL_HEADER} AS h)
UNION ALL {lines_of('card_text', 1, 'pos', 'lines')}""")

RUN = "coalesce(nullif(substring(published, 1, 10), ''), '2024-01-31')"

SQL = {
    "meaningful_filter": "WITH " + ANALYSED + f"""
SELECT pos, array_to_string({items('tags')}, {SEP}) AS tags, CAST(len({items('tags')}) AS INTEGER) AS n_tags,
       {meaningful('summary')} AS summary_meaningful, {meaningful('why_selected')} AS why_meaningful FROM analysed""",
    "digest_rank": "WITH " + ANALYSED + "\nSELECT topic, pos, CAST(digest_rank AS INTEGER) AS digest_rank FROM ranked",
    "recommendation_counts": "WITH " + ANALYSED + """
SELECT t.topic, coalesce(c.n_read, 0) AS n_read, coalesce(c.n_skim, 0) AS n_skim, coalesce(c.n_watch, 0) AS n_watch, coalesce(c.n_ignore, 0) AS n_ignore
FROM topics t LEFT JOIN (
  SELECT topic, count(*) FILTER (WHERE recommendation = 'read') AS n_read, count(*) FILTER (WHERE recommendation = 'skim') AS n_skim,
         count(*) FILTER (WHERE recommendation = 'watch') AS n_watch, count(*) FILTER (WHERE recommendation = 'ignore') AS n_ignore
  FROM analysed GROUP BY topic) c ON c.topic = t.topic""",
    "digest_sections": "WITH " + ANALYSED + "\nSELECT topic, pos, section, CAST(section_rank AS INTEGER) AS section_rank FROM sectioned",
    "digest_topline": "WITH " + ANALYSED + ",\n" + TOPLINE + "\nSELECT topic, best_title, counts_line FROM topline",
    "digest_cards": "WITH " + ANALYSED + ",\n" + CARDS + f"""
SELECT topic, pos, badge, card_title, display_source, display_published, card_content_source, card_status, card_summary, card_take,
       card_action, card_why, array_to_string(card_tags, {SEP}) AS card_tags, card_error,
       array_to_string(card_technically_sound_claims, {SEP}) AS card_technically_sound_claims,
       array_to_string(card_marketing_or_hype, {SEP}) AS card_marketing_or_hype,
       array_to_string(card_claims_to_verify, {SEP}) AS card_claims_to_verify,
       array_to_string(card_why_it_matters_to_me, {SEP}) AS card_why_it_matters_to_me,
       (len(card_technically_sound_claims) + len(card_marketing_or_hype) + len(card_claims_to_verify) + len(card_why_it_matters_to_me)) > 0 AS card_has_details
FROM cards""",
    "digest_report": REPORT,
    "manual_report": MANUAL,
    "triage_summary": "WITH " + ANALYSED + """
SELECT coalesce(nullif(title, ''), url) AS display_title, url, upper(recommendation) AS recommendation, signal_score AS signal,
       fluff_score AS fluff, technical_depth AS tech_depth, coalesce(content_source, 'unknown') AS content_source,
       coalesce(status, 'unknown') AS extraction_status, coalesce(content_chars, 0) AS chars, coalesce(summary, '') AS summary,
       coalesce(skeptical_take, '') AS skeptical_take, coalesce(suggested_action, '') AS suggested_action FROM analysed""",
    "analysis_archive": "WITH " + ANALYSED + f"\nSELECT topic, {RUN} AS run_date, pos, recommendation, title, status, md5(content) AS content_md5 FROM analysed",
    "latest_snapshot": "WITH " + ANALYSED + f""",
runs AS (SELECT topic, {RUN} AS run_date FROM analysed)
SELECT topic, max(run_date) AS latest_run_date, count(*) FILTER (WHERE run_date = mx) AS n_articles
FROM (SELECT *, max(run_date) OVER (PARTITION BY topic) AS mx FROM runs) GROUP BY topic""",
    "slugify": f"""
SELECT doc_id, {q('')} || CASE WHEN s2 = '' THEN '' ELSE '' END || regexp_replace(substring(s3, 1, 60), '^-+|-+\\z', '', 'g') AS slug
FROM (SELECT doc_id, s2, CASE WHEN s2 = '' THEN '{C.SLUG_DEFAULT}' ELSE s2 END AS s3
      FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+\\z', '', 'g') AS s2 FROM documents))""",
}
_ = lst
