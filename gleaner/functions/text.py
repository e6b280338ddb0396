"""Text scalars as Catalyst expressions (no Python per row).

Regex patterns are written in the subset that Java and RE2 read the same way:
``\\x{..}`` escapes instead of ``\\s``/``\\v`` shorthands, ``\\z`` instead of ``$``.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C

# Python's str.isspace() set, as a character-class body (Java and RE2 agree on it).
PY_WS_CLASS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
PY_WS = "[" + PY_WS_CLASS + "]"
STRIP_PATTERN = "^" + PY_WS + "+|" + PY_WS + r"+\z"

# Named references come from the standard library's HTML5 table: those that end with a
# semicolon, and the old ones that also count without it (the longest that fits).
_NAMED = {name: char for name, char in html5.items() if name.endswith(";")}
_OLD = {name: html5[name] for name in sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)}
# what numbers 128 to 159 stand for
_C1 = "".join(html.unescape(f"&#{code};") for code in range(0x80, 0xA0))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.isspace() accepts (the set str.strip() removes).
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends (a character-set
    trim, which only looks at the two ends instead of scanning the string)."""
    return F.btrim(_col(c), F.lit(PY_WS_CHARS))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (a lambda binds it)."""
    return F.transform(F.array(value), use)[0]


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    """The value of ``key`` in a fixed table, which the optimizer folds to one map literal."""
    sides = [F.split(F.lit("\x01".join(side)), "\x01", -1) for side in (table, table.values())]
    return F.try_element_at(F.map_from_arrays(*sides), key)


def _numbered(code: Column) -> Column:
    """The character that a numeric reference stands for, '' for those that stand for none."""
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.substring(F.lit(_C1), code - 0x7F, F.lit(1)))
        .when(dropped, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _reference(p: Column) -> Column:
    """``p``, what follows an ampersand, with the reference that it begins with decoded."""

    def done(token, char):
        return F.concat(char, F.substring(p, F.length(token) + 1, F.length(p)))

    def number(token):
        digits = F.regexp_extract(token, r"^#[xX]?0*([0-9a-fA-F]*);?$", 1)
        hexadecimal = token.rlike("^#[xX]")
        code = (
            F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000)
            .when(hexadecimal, F.conv(digits, 16, 10).cast("int")).otherwise(digits.cast("int"))
        )
        return done(token, _bind(code, _numbered))

    def name(token):
        old = F.regexp_extract(p, "^(?:" + "|".join(_OLD) + ")", 0)
        short = _bind(old, lambda o: F.when(o == "", F.concat(F.lit("&"), p)).otherwise(done(o, _looked_up(o, _OLD))))
        char = F.when(token != "", _looked_up(token, _NAMED))
        return _bind(char, lambda c: F.when(c.isNotNull(), done(token, c)).otherwise(short))

    numeric = F.regexp_extract(p, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    named = F.regexp_extract(p, r"^[a-zA-Z][a-zA-Z0-9]{1,31};", 0)
    return _bind(numeric, lambda n: F.when(n != "", number(n)).otherwise(_bind(named, name)))


def html_unescape(c) -> Column:
    """One level of character references decoded, all of HTML5 (``&amp;amp;`` -> ``&amp;``): the text
    is cut at its ampersands once and each reference is looked up once."""

    def decoded(x: Column) -> Column:
        def joined(parts):
            return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _reference), ""))

        return F.when(F.contains(x, F.lit("&")), _bind(F.split(x, "&", -1), joined)).otherwise(x)

    return _bind(_col(c), decoded)


def clean_whitespace(c) -> Column:
    """Unescape, nbsp -> space, collapse horizontal whitespace, cap blank lines, strip."""
    out = html_unescape(c)
    out = F.replace(out, F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, r"[ \t\r\f\x{B}]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return py_strip(out)


def slugify(c, max_len: int = C.SLUG_MAX_LEN) -> Column:
    """Lower-case alphanumerics joined by single dashes, cut to ``max_len``."""
    s = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "-")
    s = F.regexp_replace(s, r"^-+|-+\z", "")
    s = F.when(s == "", F.lit(C.SLUG_DEFAULT)).otherwise(s)
    s = F.substring(s, 1, max_len)
    return F.regexp_replace(s, r"^-+|-+\z", "")


def strip_spinner(c) -> Column:
    """Strip, then drop leading spinner frames and whitespace."""
    return F.regexp_replace(py_strip(c), "^[" + C.SPINNER_FRAMES + PY_WS_CLASS + "]+", "")


def truncate_text(c, max_chars: int = C.MAX_ANALYSIS_CHARS) -> Column:
    """Cut over-long text at ``max_chars``, drop the partial last line, mark it."""
    col = _col(c)
    cut = F.substring(col, 1, max_chars)
    cut = py_strip(F.regexp_replace(cut, r"\n[^\n]*\z", ""))
    return F.when(F.length(col) > max_chars, F.concat(cut, F.lit("\n\n" + C.TRUNCATION_MARKER))).otherwise(col)
