"""URL filters: a temporal join of captures with dated block lists.

List entries are dated events (list, kind, key, add or remove). Each (list, kind, key)
history becomes validity intervals; a capture is evaluated against the entries that
were active when it was fetched. A capture asks for a bounded set of keys: its host
and every parent domain (kind ``domain``), its exact host (``host``) and every
directory prefix of its path (``prefix``, host included). Keys meet in an equi-join;
the as-of test looks up the fetch time in the key's sorted intervals.

Intervals are one row per key, so the join adds no rows per interval, and captures are
reduced to distinct (key, fetch time) pairs before they meet the lists: a host that
holds a third of all captures sends each fetch time once per task.

Cases: a capture without a parsable host, or with a null url or time, matches nothing
and is kept; list events with a null key or time are ignored; of several events of a
key at one time a removal wins; repeated events change nothing; repeated captures
stay rows of their own; empty tables give no match or no rows; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import row_key, table


def host_of(url: Column) -> Column:
    """Lower-cased host without port or user part; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def capture_keys(host: Column, path: Column) -> Column:
    """array<string> of ``kind:key``: parent domains, the host and directory prefixes."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    parts = F.split(path, "/")
    prefixes = F.when(F.size(parts) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def validity(events: DataFrame) -> DataFrame:
    """(entry, list, intervals): sorted, disjoint [from, to) periods; an open end is null.

    One fold per key over its own dated history; at one time a removal wins.
    """
    clean = events.where(F.col("entry").isNotNull() & F.col("at").isNotNull())
    daily = clean.groupBy("entry", "list", "at").agg(F.min("active").alias("active"))
    history = daily.groupBy("entry", "list").agg(F.array_sort(F.collect_list(F.struct("at", "active"))).alias("h"))
    spans = F.expr(
        """filter(transform(h, (x, i) -> named_struct('active', x.active and (i = 0 or not h[i - 1].active), 'from', x.at,
             'to', array_min(transform(filter(slice(h, i + 2, size(h)), y -> not y.active), y -> y.at)))), s -> s.active)"""
    )
    return history.select("entry", "list", F.transform(spans, lambda s: F.struct(s["from"].alias("start"), s["to"].alias("stop"))).alias("intervals"))


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Every capture (id, url, fetched_at) with what applied at its time.

    Adds host, n_active (entries active then), blocked_by (lists, sorted, joined by
    ``,``) and first_entry (smallest active entry), null where nothing applied.
    """
    keyed = captures.select(row_key().alias("_row"), "id", "url", "fetched_at", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("_path"))
    asked = keyed.select("_row", "fetched_at", F.explode(capture_keys(F.col("host"), F.col("_path"))).alias("entry")).where(F.col("fetched_at").isNotNull())
    # the lists are asked once per distinct (key, time)
    lists = validity(events)
    moments = asked.select("entry", "fetched_at").distinct()
    active = F.exists("intervals", lambda v: (v["start"] <= F.col("fetched_at")) & (v["stop"].isNull() | (F.col("fetched_at") < v["stop"])))
    verdicts = moments.join(lists, "entry").where(active).groupBy("entry", "fetched_at").agg(F.collect_set("list").alias("lists"))
    hits = asked.join(verdicts, ["entry", "fetched_at"]).groupBy("_row").agg(
        F.sum(F.size("lists")).cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))), ",").alias("blocked_by"),
        F.min("entry").alias("first_entry"),
    )
    return keyed.join(hits.hint("shuffle_hash"), "_row", "left").select(
        "id", "url", "fetched_at", F.when(F.col("host") != "", F.col("host")).alias("host"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "blocked_by", "first_entry",
    )


def _digits(c: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(c), start, 4), 16, 10).cast("int")


#: days that the derived list entries and captures are spread over
DAYS = 365


def derived_events(pages: DataFrame) -> DataFrame:
    """Dated list entries that Spark derives from the crawl itself.

    Half of all hosts are listed (as host, or as the domain without its first label) and
    a third of all first directories; the day of listing, of removal and of a second
    listing come from digests of the entry.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    by_host = hosts.select("host").distinct().where(_digits(F.col("host"), 1) % 2 == 0)
    by_host = by_host.select(
        F.when(_digits(F.col("host"), 5) % 3 == 0, F.concat(F.lit("domain:"), F.regexp_replace("host", r"^[^.]*\.", ""))).otherwise(F.concat(F.lit("host:"), F.col("host"))).alias("entry"),
        F.concat(F.lit("list"), (_digits(F.col("host"), 9) % 3).cast("string")).alias("list"),
    )
    by_prefix = hosts.select(F.concat(F.lit("prefix:"), F.col("host"), F.regexp_extract("path", "^(/[^/]*/)", 1)).alias("entry")).where("entry like '%/'").distinct()
    by_prefix = by_prefix.where(_digits(F.col("entry"), 1) % 3 == 0).select("entry", F.lit("list3").alias("list"))
    entries = by_host.unionByName(by_prefix).distinct()
    day = _digits(F.concat("entry", F.lit("|"), "list"), 13) % DAYS
    length = _digits(F.concat("entry", F.lit("|"), "list"), 17) % 120 + 1
    moments = F.array(F.struct(day.alias("at"), F.lit(True).alias("active")), F.struct((day + length).alias("at"), F.lit(False).alias("active")), F.struct((day + 2 * length).alias("at"), F.lit(True).alias("active")))
    return entries.select("entry", "list", F.inline(moments))


def q_url_filters(spark, sf_dir):
    """Every page as a capture; fetch days from its id, list events derived from the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("id"), "url", (_digits(F.col("page_id").cast("string"), 1) % (2 * DAYS)).alias("fetched_at"))
    out = filter_captures(captures, derived_events(pages))
    return out.select(F.col("id").alias("page_id"), "url", F.col("fetched_at").alias("fetch_day"), "host", "n_active", "blocked_by", "first_entry")


def _dig(x: str, start: int) -> str:
    return f"CAST(('0x' || substring(md5({x}), {start}, 4)) AS INTEGER)"


SQL = rf"""
WITH p AS (
  SELECT page_id, url, {_dig("CAST(page_id AS VARCHAR)", 1)} % {2 * DAYS} AS fetch_day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
by_host AS (
  SELECT CASE WHEN {_dig("host", 5)} % 3 = 0 THEN 'domain:' || regexp_replace(host, '^[^.]*\.', '') ELSE 'host:' || host END AS entry,
         'list' || CAST({_dig("host", 9)} % 3 AS VARCHAR) AS list
  FROM (SELECT DISTINCT host FROM p WHERE host <> '') WHERE {_dig("host", 1)} % 2 = 0
),
by_prefix AS (
  SELECT entry, 'list3' AS list
  FROM (SELECT DISTINCT 'prefix:' || host || regexp_extract(path, '^(/[^/]*/)', 1) AS entry FROM p WHERE host <> '')
  WHERE entry LIKE '%/' AND {_dig("entry", 1)} % 3 = 0
),
entries AS (SELECT * FROM by_host UNION SELECT * FROM by_prefix),
days AS (
  SELECT entry, list, {_dig("entry || '|' || list", 13)} % {DAYS} AS d, {_dig("entry || '|' || list", 17)} % 120 + 1 AS n FROM entries
),
spans AS (
  SELECT entry, list, d AS start, d + n AS stop FROM days
  UNION ALL SELECT entry, list, d + 2 * n, NULL FROM days
),
hits AS (
  SELECT p.page_id, s.entry, s.list FROM p JOIN spans s
    ON s.start <= p.fetch_day AND (s.stop IS NULL OR p.fetch_day < s.stop) AND p.host <> ''
   AND (s.entry = 'host:' || p.host
     OR (s.entry LIKE 'domain:%' AND ('.' || p.host) LIKE ('%.' || substring(s.entry, 8)))
     OR (s.entry LIKE 'prefix:%' AND starts_with(p.host || p.path, substring(s.entry, 8))))
),
agg AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS blocked_by, min(entry) AS first_entry
  FROM hits GROUP BY page_id
)
SELECT p.page_id, p.url, p.fetch_day, nullif(p.host, '') AS host, coalesce(a.n, 0) AS n_active, a.blocked_by, a.first_entry
FROM p LEFT JOIN agg a USING (page_id)
"""
