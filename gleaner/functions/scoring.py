"""Relevance and discovery scoring as column expressions.

The topic is a literal per run, so its tokens and active keyword categories are
resolved once on the driver (constant hoisting) and the per-row work is a fixed
sum of ``contains`` tests: narrow, codegen'd, no join against a dictionary.
Matching is by substring on purpose ("chain" contains "ai"); ``contains`` is used,
never a regex, because keywords such as ``ci/cd`` or ``llama.cpp`` hold regex
metacharacters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_words(topic: str) -> list[str]:
    """Driver-side tokens of a literal topic (not deduplicated, no stop words)."""
    return [w for w in re.split(C.TOPIC_SPLIT_PATTERN, topic.lower()) if len(w) >= C.TOPIC_MIN_WORD_LEN]


def active_keywords(topic: str) -> list[tuple[str, str]]:
    """(category, keyword) pairs whose category name occurs in the topic."""
    t = topic.lower()
    return [(cat, kw) for cat, kws in C.TOPIC_KEYWORDS.items() if cat in t for kw in kws]


def topic_tokens(c) -> Column:
    """Tokens of a topic column: lower, split on non-word characters, keep length > 2."""
    return F.filter(F.split(F.lower(_col(c)), C.TOPIC_SPLIT_PATTERN, -1), lambda w: F.length(w) >= C.TOPIC_MIN_WORD_LEN)


def haystack(text, feed_tags) -> Column:
    """lower(text + newline + feed tags joined by a space)."""
    return F.lower(F.concat(_col(text), F.lit("\n"), F.array_join(F.coalesce(_col(feed_tags), F.array().cast("array<string>")), " ")))


def topic_score(topic: str, hay: Column) -> Column:
    """8 per topic word found in the haystack + 5 per active category keyword found."""
    terms = [(w, C.TOPIC_WORD_POINTS) for w in topic_words(topic)]
    terms += [(kw, C.KEYWORD_POINTS) for _, kw in active_keywords(topic)]
    if not terms:
        return F.lit(0)
    total = None
    for word, points in terms:
        part = F.when(hay.contains(word), F.lit(points)).otherwise(F.lit(0))
        total = part if total is None else total + part
    return total


def keyword_hits(topic: str, hay: Column) -> Column:
    """Array of (category, keyword) structs hit by the haystack, dictionary order."""
    pairs = active_keywords(topic)
    if not pairs:
        return F.array().cast("array<struct<category:string,keyword:string>>")
    return F.filter(
        F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(kw).alias("keyword")) for cat, kw in pairs]),
        lambda s: F.contains(hay, s["keyword"]),
    )


def weight_bonus(weight) -> Column:
    """int(float(weight) * 10), truncating; default weight 0.5."""
    return (F.coalesce(_col(weight).cast("double"), F.lit(C.DEFAULT_FEED_WEIGHT)) * 10).cast("int")


def age_days(published, as_of: Column) -> Column:
    """Whole 24-hour days between published and as_of (floor), at least 0."""
    micros = F.timestamp_diff("MICROSECOND", _col(published), as_of)
    return F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000)).cast("int"))


def recency_bonus(published, as_of: Column) -> Column:
    """max(0, 14 - age) for dated entries, 0 for undated ones."""
    return F.when(_col(published).isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.lit(C.RECENCY_BONUS_DAYS) - age_days(published, as_of))
    )


def iso_utc(ts) -> Column:
    """ISO-8601 with a +00:00 offset for a UTC wall-clock timestamp, '' when null."""
    return F.coalesce(F.concat(F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.lit(""))
