"""URL normalisation as one Catalyst expression tree.

Semantics (Python urllib round trip): strip; lower-case scheme and authority; drop
``;params`` of the last path segment and the fragment; strip trailing slashes
unless that empties the path; decode the query (``+`` is a space, stray ``%``
kept), drop tracking parameters by lower-cased name, keep blank values, drop
empty segments, and re-encode every key and value with ``quote_plus``.

``parse_url`` is not used: it raises (or returns NULL) on spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.text import py_strip

# scheme, "//authority", path, query, fragment
URL_PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_decode(c) -> Column:
    """``unquote_plus``: '+' is a space, invalid '%xx' escapes are kept as text."""
    fixed = F.regexp_replace(_col(c), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(fixed), _col(c))


def quote_plus(c) -> Column:
    """``urllib.parse.quote_plus`` with safe=''. Java's encoder differs on '~' and '*'."""
    enc = F.url_encode(_col(c))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(query: Column) -> Column:
    """Decode, drop tracking params and empty segments, re-encode; '' when nothing is left."""
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            percent_decode(F.when(F.instr(p, "=") > 0, F.substring_index(p, "=", 1)).otherwise(p)).alias("k"),
            percent_decode(
                F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, 1 << 30)).otherwise(F.lit(""))
            ).alias("v"),
        ),
    )
    tracking = F.array(*[F.lit(t) for t in C.TRACKING_PARAMS])
    kept = F.filter(pairs, lambda kv: ~F.array_contains(tracking, F.lower(kv["k"])))
    return F.array_join(F.transform(kept, lambda kv: F.concat(quote_plus(kv["k"]), F.lit("="), quote_plus(kv["v"]))), "&")


def normalize_url(c) -> Column:
    s = py_strip(_col(c))
    s = F.regexp_replace(s, "[\t\r\n]", "")
    s = F.regexp_replace(s, r"^[\x{0}-\x{20}]+", "")
    scheme = F.lower(F.regexp_extract(s, URL_PATTERN, 1))
    auth = F.regexp_extract(s, URL_PATTERN, 2)
    netloc = F.lower(F.substring(auth, 3, 1 << 30))
    raw_path = F.regexp_extract(s, URL_PATTERN, 3)
    query = F.regexp_extract(s, URL_PATTERN, 4)

    params_schemes = F.array(*[F.lit(x) for x in C.SCHEMES_WITH_PARAMS])
    netloc_schemes = F.array(*[F.lit(x) for x in C.SCHEMES_WITH_NETLOC])
    path = F.when(F.array_contains(params_schemes, scheme), F.regexp_replace(raw_path, r";[^/]*\z", "")).otherwise(raw_path)
    stripped = F.regexp_replace(path, r"/+\z", "")
    path = F.when(stripped == "", path).otherwise(stripped)

    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when((scheme != "") & F.array_contains(netloc_schemes, scheme) & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    q = clean_query(query)
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body)
    return F.when(_col(c).isNull(), F.lit(None)).otherwise(F.concat(out, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def url_authority(c) -> Column:
    """The authority (netloc) part as written, '' when absent."""
    return F.substring(F.regexp_extract(_col(c), URL_PATTERN, 2), 3, 1 << 30)


def url_scheme(c) -> Column:
    return F.lower(F.regexp_extract(_col(c), URL_PATTERN, 1))
