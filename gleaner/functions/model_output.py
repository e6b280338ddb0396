"""Recovering and normalising loosely formatted model judgements.

Raw text -> VARIANT (first decodable JSON object) -> fixed analysis struct. All of it
is Catalyst expressions over VARIANT; a row that cannot be parsed becomes an error
record in place, the batch never aborts.

Documented deviations from a Python json/int round trip: objects inside lists and
non-string scalars are rendered as JSON text (not Python repr); duplicate keys and
NaN make a document unparsable; decimal strings such as "85.5" and non-ASCII
digits do not count as integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.text import py_strip, strip_spinner

FENCED_OBJECT = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
FENCED_ARRAY = r"(?is)```(?:json)?\n(.*?)```"

MSG_NO_OBJECT = "Could not parse model JSON: No JSON object found"
MSG_BAD_FENCE = "Could not parse model JSON: fenced JSON block is malformed"
MSG_MISSING = "Model output missing."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _whole_json(text: Column) -> Column:
    """Parse text that must be exactly one JSON value (trailing text -> NULL)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(wrapped, "$[0]", "variant"))


def brace_positions(text: Column) -> Column:
    """1-based positions of every '{' in text, in order."""
    n = F.size(F.split(text, r"\{", -1)) - 1

    def step(acc, _):
        start = F.when(F.size(acc) == 0, F.lit(1)).otherwise(F.try_element_at(acc, F.lit(-1)) + 1)
        tail = F.substring(text, start, 1 << 30)
        return F.concat(acc, F.array(F.instr(tail, "{") + start - 1))

    none = F.array().cast("array<int>")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), none, step)).otherwise(none)


def first_decodable(text: Column, braces: Column) -> Column:
    """The object that decodes from the earliest brace; later braces are tried only if it fails."""
    return F.aggregate(braces, F.lit(None).cast("variant"), lambda acc, p: F.coalesce(acc, F.try_parse_json(F.substring(text, p, 1 << 30))))


def first_json_object(raw) -> Column:
    """First JSON object in model text: a fenced ```json block wins (and must parse),
    else the first '{' from which an object decodes, trailing text ignored.
    Returns a struct(obj variant, error string)."""
    cleaned = strip_spinner(_col(raw))
    fenced = F.regexp_extract(cleaned, FENCED_OBJECT, 1)
    found = first_decodable(cleaned, brace_positions(cleaned))
    fenced_obj = _whole_json(fenced)
    obj = F.when(_col(raw).isNull(), F.lit(None)).when(fenced != "", fenced_obj).otherwise(found)
    err = (
        F.when(_col(raw).isNull(), F.lit(MSG_MISSING))
        .when((fenced != "") & fenced_obj.isNull(), F.lit(MSG_BAD_FENCE))
        .when((fenced == "") & found.isNull(), F.lit(MSG_NO_OBJECT))
    )
    return F.struct(obj.alias("obj"), err.alias("error"))


def clamp_score(v: Column, key: str) -> Column:
    """int(value) clamped to 0..100; anything that is not an integer -> 0."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.try_variant_get(v, f"$.{key}", "bigint"), F.lit(0)))).cast("int")


def _item_text(x: Column) -> Column:
    """str(item) for a JSON value: null -> 'None', booleans capitalised."""
    return (
        F.when(F.is_variant_null(x), F.lit("None"))
        .when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string")))
        .otherwise(F.try_variant_get(x, "$", "string"))
    )


def text_field(v: Column, key: str) -> Column:
    """str(data.get(key, '')).strip()."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(x.isNull(), F.lit("")).otherwise(py_strip(_item_text(x)))


def string_list(v: Column, key: str) -> Column:
    """List -> trimmed non-empty item texts; non-empty string -> [it]; else []."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(x)
    items = F.try_variant_get(v, f"$.{key}", "array<variant>")
    as_list = F.filter(F.transform(items, lambda i: py_strip(_item_text(i))), lambda s: s != "")
    s = py_strip(F.try_variant_get(x, "$", "string"))
    empty = F.array().cast("array<string>")
    return (
        F.when(x.isNull() | F.is_variant_null(x), empty)
        .when(kind.startswith("ARRAY"), as_list)
        .when((kind == "STRING") & (s != ""), F.array(s))
        .otherwise(empty)
    )


def recommendation(v: Column) -> Column:
    x = F.try_variant_get(v, "$.recommendation", "variant")
    r = F.lower(F.when(x.isNull(), F.lit(C.DEFAULT_RECOMMENDATION)).otherwise(py_strip(_item_text(x))))
    return F.when(r.isin(*C.VALID_RECOMMENDATIONS), r).otherwise(F.lit(C.DEFAULT_RECOMMENDATION))


def normalize_analysis(v: Column, raw: Column | None = None) -> Column:
    """The fixed 15-field analysis struct (plus a null analysis_error)."""
    summary = text_field(v, "summary")
    if raw is not None:
        summary = F.when((summary == "") & raw.isNotNull() & (raw != ""), F.substring(strip_spinner(raw), 1, C.RAW_SUMMARY_CHARS)).otherwise(summary)
    fields = {
        "recommendation": recommendation(v),
        **{k: clamp_score(v, k) for k in C.SCORE_FIELDS},
        "summary": summary,
        "why_selected": text_field(v, "why_selected"),
        **{k: string_list(v, k) for k in C.LIST_FIELDS[:4]},
        "skeptical_take": text_field(v, "skeptical_take"),
        "suggested_action": text_field(v, "suggested_action"),
        "tags": string_list(v, "tags"),
    }
    return F.struct(*[fields[k].alias(k) for k in C.ANALYSIS_FIELDS], F.lit(None).cast("string").alias("analysis_error"))


def error_analysis(message: Column) -> Column:
    """The fixed 'ignore' record that carries a failure message."""
    empty = F.array().cast("array<string>")
    fields = {
        "recommendation": F.lit("ignore"),
        **{k: F.lit(0) for k in C.SCORE_FIELDS},
        "summary": message,
        "why_selected": F.lit(C.ERROR_WHY_SELECTED),
        "technically_sound_claims": empty,
        "marketing_or_hype": empty,
        "claims_to_verify": F.array(message),
        "why_it_matters_to_me": empty,
        "skeptical_take": F.lit(C.ERROR_SKEPTICAL_TAKE),
        "suggested_action": F.lit(C.ERROR_SUGGESTED_ACTION),
        "tags": F.array(F.lit(C.ERROR_TAG)),
    }
    return F.struct(*[fields[k].alias(k) for k in C.ANALYSIS_FIELDS], message.alias("analysis_error"))


def json_array_block(text) -> Column:
    """A JSON array from a ```json fenced block if present, else from the whole text."""
    t = _col(text)
    fenced = F.regexp_extract(t, FENCED_ARRAY, 1)
    body = F.when(F.regexp_extract(t, r"(?is)(```(?:json)?\n.*?```)", 1) != "", fenced).otherwise(t)
    return F.from_json(body, "array<struct<title:string,url:string,content:string>>")
