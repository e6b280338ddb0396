"""Feed sources: RSS/Atom entries, the feed list, topic lists and seen-state files.

Landed feed files are read with Spark's XML source (``rowTag`` item / entry);
payloads already in a column go through ``from_xml`` with the same schemas.
Malformed records are kept (PERMISSIVE) with the raw text in ``_corrupt_record``:
entries that parsed are still used, like a feed that parses with a warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RSS_ITEM_SCHEMA = "title string, link string, description string, category array<string>, pubDate string, guid string, _corrupt_record string"
ATOM_ENTRY_SCHEMA = (
    "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, "
    "category array<struct<_term:string>>, published string, updated string, id string, _corrupt_record string"
)
FEED_CONFIG_SCHEMA = T.StructType([
    T.StructField("feeds", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("weight", T.DoubleType()),
    ]))),
])
SEEN_MAP_SCHEMA = "map<string,struct<first_seen:string,last_seen:string,title:string,source:string,published:string>>"

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
RFC822_RE = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}) (" + MONTHS + r") (\d{4}|\d{2}) (\d{1,2}:\d{2}(?::\d{2})?)\s*(GMT|UTC|UT|Z|[ECMP][SD]T|[+-]\d{4})?\s*$"
ISO_RE = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
# hours east of UTC of the zone names that mail dates may carry
ZONE_HOURS = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def _offset_minutes(z: Column) -> Column:
    """'+0130' / '-05:00' / 'PDT' / 'Z' / 'GMT' / '' -> signed minutes east of UTC."""
    digits = F.regexp_replace(z, ":", "")
    sign = F.when(F.substring(digits, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.substring(digits, 2, 2).cast("int")
    mm = F.substring(digits, 4, 2).cast("int")
    return F.when(digits.rlike(r"^[+-]\d{4}$"), sign * (hh * 60 + mm)).otherwise(
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ZONE_HOURS.items() for x in kv]), z) * 60, F.lit(0))
    )


def _ntz(y: Column, mo: Column, d: Column, clock: Column) -> Column:
    """Parts -> TIMESTAMP_NTZ; impossible dates (31 Feb) give NULL, never an error."""
    parts = F.split(clock, ":")
    sec = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("0"))
    return F.try_make_timestamp_ntz(y.cast("int"), mo.cast("int"), d.cast("int"),
                                    F.try_element_at(parts, F.lit(1)).cast("int"), F.try_element_at(parts, F.lit(2)).cast("int"),
                                    sec.cast("decimal(16,6)"))


def parse_feed_date(s) -> Column:
    """RFC 822 or ISO-8601 feed date -> UTC wall-clock TIMESTAMP_NTZ, NULL when unparsable.

    The text is matched by pattern and assembled from its parts, so a bad date
    yields NULL instead of failing the batch (the weekday is ignored). A date without a
    clock is midnight UTC."""
    x = F.trim(s if isinstance(s, Column) else F.col(s))
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS.split("|")]), F.regexp_extract(x, RFC822_RE, 2))
    year = F.regexp_extract(x, RFC822_RE, 3)
    # two digits: 69 to 99 are the last century
    year = F.when(F.length(year) == 2, year.cast("int") + F.when(year.cast("int") < 69, 2000).otherwise(1900)).otherwise(year.cast("int"))
    rfc_local = _ntz(year, month_no, F.regexp_extract(x, RFC822_RE, 1), F.regexp_extract(x, RFC822_RE, 4))
    iso_date = F.split(F.regexp_extract(x, ISO_RE, 1), "-")
    iso_local = _ntz(F.try_element_at(iso_date, F.lit(1)), F.try_element_at(iso_date, F.lit(2)), F.try_element_at(iso_date, F.lit(3)),
                     F.coalesce(F.nullif(F.regexp_extract(x, ISO_RE, 2), F.lit("")), F.lit("00:00")))
    rfc = F.regexp_extract(x, RFC822_RE, 0) != ""
    iso = F.regexp_extract(x, ISO_RE, 0) != ""
    rfc_utc = rfc_local - F.make_dt_interval(F.lit(0), F.lit(0), _offset_minutes(F.regexp_extract(x, RFC822_RE, 5)))
    iso_utc = iso_local - F.make_dt_interval(F.lit(0), F.lit(0), _offset_minutes(F.regexp_extract(x, ISO_RE, 3)))
    return F.when(rfc, rfc_utc).when(iso, iso_utc)


def rss_entries(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """RSS <item> rows -> entry columns (link, title, summary, terms, published)."""
    return items.select(
        *(keep or []),
        F.col("link"),
        F.col("title"),
        F.col("description").alias("summary"),
        F.coalesce(F.col("category"), F.array().cast("array<string>")).alias("terms"),
        parse_feed_date(F.col("pubDate")).alias("published"),
        F.lit(None).cast("timestamp_ntz").alias("updated"),
    )


def atom_entries(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Atom <entry> rows -> entry columns; the link is the first alternate (or first) href."""
    alt = F.filter(F.col("link"), lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return entries.select(
        *(keep or []),
        F.coalesce(F.try_element_at(alt, F.lit(1))["_href"], F.try_element_at(F.col("link"), F.lit(1))["_href"]).alias("link"),
        F.col("title"),
        F.coalesce(F.col("summary"), F.col("content")).alias("summary"),
        F.transform(F.coalesce(F.col("category"), F.array().cast("array<struct<_term:string>>")), lambda c: c["_term"]).alias("terms"),
        parse_feed_date(F.col("published")).alias("published"),
        parse_feed_date(F.col("updated")).alias("updated"),
    )


def read_feed_files(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """Landed feed documents (one feed per file) -> entry rows with the source file."""
    tag, schema, conv = ("item", RSS_ITEM_SCHEMA, rss_entries) if kind == "rss" else ("entry", ATOM_ENTRY_SCHEMA, atom_entries)
    raw = (
        spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path)
        .withColumn("file", F.input_file_name())
    )
    return conv(raw, keep=["file"])


def read_landed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Every feed document under ``folder/feed_id=<id>/`` -> entries with their place in the feed.

    RSS items and Atom entries form one bag. ``entry_no`` (from 1) follows a feed's files
    by name and the order inside them; ``pos`` orders all entries by feed, then entry (feeds
    below 2^23, entries below 2^40). ``malformed`` marks what could not be parsed
    (``quarantine``): both scans report a malformed record, with the whole document as its
    text, so only the ``file`` is kept; such rows leave gaps in ``entry_no``. Files are parsed once, into a checkpoint: numbers come
    from counts per file, so no text is shuffled and a hot feed is never one task.
    """
    from gleaner.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)

    def scan(kind: str, tag: str, schema: str, entries) -> DataFrame:
        raw = (
            spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").schema(f"{schema}, feed_id long").load(folder)
        )
        placed = raw.select(
            "*", F.lit(kind).alias("kind"), F.col("_corrupt_record").isNotNull().alias("malformed"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid"),
        )
        return entries(placed, keep=["feed_id", "kind", "malformed", "file", "_block", "_mid"])

    landed = scan("rss", "item", RSS_ITEM_SCHEMA, rss_entries).unionByName(scan("atom", "entry", ATOM_ENTRY_SCHEMA, atom_entries)).checkpoint(eager=True)
    parts = ["feed_id", "file", "_block", "kind"]
    counts = landed.groupBy(*parts).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("feed_id").orderBy("file", "_block", "kind"))
    numbered = landed.join(counts.withColumn("_before", upto - F.col("_n")), parts)
    entry_no = F.col("_mid") - F.col("_first") + F.col("_before") + 1
    return numbered.withColumn("entry_no", entry_no).withColumn("pos", F.shiftleft(F.col("feed_id"), 40) + F.col("entry_no")).drop(
        "_block", "_mid", "_first", "_n", "_before"
    )


def quarantine(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good entries, one row per file with malformed records) of ``read_landed_feeds``."""
    bad = landed.where("malformed").groupBy("feed_id", "file").agg(F.min("entry_no").alias("first_entry_no"), F.count(F.lit(1)).alias("n_rows"))
    return landed.where("not malformed").drop("malformed"), bad


def parse_rss_items(df: DataFrame, xml_col: str) -> DataFrame:
    """Item payloads already in a column -> entry columns (other columns kept)."""
    keep = [c for c in df.columns if c != xml_col]
    parsed = df.select(*keep, F.from_xml(F.col(xml_col), RSS_ITEM_SCHEMA, {"mode": "PERMISSIVE"}).alias("_x"))
    return rss_entries(parsed.select(*keep, "_x.*"), keep=keep)


def read_feed_config(spark: SparkSession, path: str) -> DataFrame:
    """Feed list JSON {"feeds": [...]}: one row per feed, ``feed_id`` its place (from 0); a missing file gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        cfg = spark.read.schema(FEED_CONFIG_SCHEMA).option("multiLine", "true").json(path)
    except AnalysisException:
        cfg = spark.createDataFrame([], FEED_CONFIG_SCHEMA)
    return cfg.select(F.posexplode("feeds").alias("feed_id", "f")).select(F.col("feed_id").cast("long").alias("feed_id"), "f.*")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic file: blank lines dropped, lines starting with '#' dropped (tested on the
    unstripped line), the rest stripped; order kept in ``pos``; no dedup."""
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("pos"))
    from gleaner.functions.text import py_strip

    return lines.where((py_strip("value") != "") & ~F.col("value").startswith("#")).select("pos", py_strip("value").alias("topic"))


def parse_seen_map(docs: DataFrame, col: str = "value") -> DataFrame:
    """Seen-state JSON objects {url: {first_seen, last_seen, ...}} -> one row per url."""
    m = docs.select(F.from_json(F.col(col), SEEN_MAP_SCHEMA).alias("m"))
    return m.select(F.explode("m").alias("url", "r")).select("url", "r.*")


def read_seen_json(spark: SparkSession, path: str) -> DataFrame:
    """Legacy seen-state file (one JSON map document) -> rows. A missing file is empty.
    A snapshot of real size is kept as Parquet (``sinks.state``), not as one document."""
    from pyspark.errors import AnalysisException

    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException:
        docs = spark.createDataFrame([], "value string")
    return parse_seen_map(docs)


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """Recent-topic history (JSON array of strings, oldest first) -> (pos, topic);
    a missing file is empty."""
    from pyspark.errors import AnalysisException

    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException:
        docs = spark.createDataFrame([], "value string")
    arr = docs.select(F.from_json(F.col("value"), "array<string>").alias("a"))
    return arr.select(F.posexplode("a").alias("pos", "topic"))
