"""Bytes to text for the charsets of landed pages, malformed input becoming U+FFFD.

Single-byte charsets are one table each, built from the standard library's codecs: the
bytes are read as Latin-1 and the characters that differ are translated. UTF-16 is read
by its 16-bit units; a surrogate without its partner, or half a unit at the end (a byte
cap may cut a pair), becomes U+FFFD before the units are decoded, so decoding never
fails. Charsets of several bytes other than these are left to ``decode_multibyte``, one
Arrow-batched step over the pages that need it.
"""

import codecs
from encodings.aliases import aliases

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import _bind as bind

_UNICODE = ["utf_8", "utf_8_sig", "utf_16", "utf_16_le", "utf_16_be"]


def _is_text(codec: str) -> bool:
    """Whether this platform has the codec and it decodes text."""
    try:
        return codecs.lookup(codec)._is_text_encoding
    except LookupError:
        return False


def _single_byte(codec: str) -> str | None:
    """The 256 characters of a single-byte codec, else None."""
    try:
        chars = [bytes([b]).decode(codec, "replace") for b in range(256)]
        # in a single-byte charset a byte means the same inside a longer text
        return "".join(chars) if all(len(c) == 1 for c in chars) and bytes(range(256)).decode(codec, "replace") == "".join(chars) else None
    except (UnicodeError, ValueError):
        return None


def _tables() -> tuple[dict[str, str], dict[str, str], list[str]]:
    """(charset name -> codec, single-byte codec -> the Latin-1 characters it reads otherwise and what for, multi-byte codecs)."""
    names = {**{codec: codec for codec in aliases.values()}, **{a.strip("_").replace(".", "_"): codec for a, codec in aliases.items()}, "utf_8_sig": "utf_8_sig"}
    names = {name: codec for name, codec in names.items() if name == name.lower() and _is_text(codec)}
    tables, several = {}, []
    for codec in sorted(set(names.values())):
        chars = _single_byte(codec)
        if chars:
            other = [b for b in range(256) if chars[b] != chr(b)]
            tables[codec] = "".join(map(chr, other)) + "".join(chars[b] for b in other)
        elif codec not in _UNICODE:
            several.append(codec)
    return names, tables, several


_NAMES, _TABLES, _SEVERAL = _tables()


def _lookup(key: Column, table: dict[str, str]) -> Column:
    sides = [F.split(F.lit("\x00\x00".join(side)), "\x00\x00", -1) for side in (table, table.values())]
    return F.try_element_at(F.map_from_arrays(*sides), key)


def charset(content_type: Column) -> Column:
    """The charset that a content type names, as written ('utf-8' if it names none)."""
    named = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([^;]+)", 1)
    return bind(named, lambda n: F.when(n == "", "utf-8").otherwise(F.trim(n)))


def codec(content_type: Column) -> Column:
    """The codec of a content type's charset; null for one that nobody knows."""
    plain = F.regexp_replace(F.lower(charset(content_type)), "[^a-z0-9.]+", "_")
    name = F.regexp_replace(F.regexp_replace(plain, "^_+|_+$", ""), r"\.", "_")
    return _lookup(name, _NAMES)


def _utf16(body: Column, big: bool) -> Column:
    """UTF-16 units, lone surrogates and half a unit replaced, decoded."""
    digits = F.hex(body) if big else F.regexp_replace(F.hex(body), "(..)(..)", "$2$1")

    def repaired(units):
        def one(u, i):
            after, before = F.coalesce(F.get(units, i + 1), F.lit("")), F.coalesce(F.get(units, i - 1), F.lit(""))
            paired = F.when(u < "DC00", after.between("DC00", "DFFF")).otherwise(before.between("D800", "DBFF"))
            return F.when(u.between("D800", "DFFF") & ~paired, "FFFD").otherwise(u)

        # a first surrogate and half a unit after it at the end are one mark
        last = F.coalesce(F.get(units, F.size(units) - 1), F.lit(""))
        half = F.when((F.length(body) % 2 == 1) & ~last.between("D800", "DBFF"), "FFFD").otherwise("")
        return F.concat(F.array_join(F.transform(units, one), ""), half)

    return F.decode(F.unhex(bind(F.regexp_extract_all(digits, F.lit("...."), 0), repaired)), "UTF-16BE")


def decode_bytes(body: Column, name: Column) -> Column:
    """Text of ``body`` in codec ``name``; null for charsets of several bytes outside Unicode, and for no codec."""
    latin = F.decode(body, "ISO-8859-1")

    def single(pair):
        half = (F.length(pair) / 2).cast("int")
        sides = [F.substring(pair, F.lit(1), half), F.substring(pair, half + 1, half)]
        return F.when(pair == "", latin).otherwise(F.call_function("translate", latin, *sides))

    utf8 = F.make_valid_utf8(body.cast("string"))
    mark = F.hex(F.substring(body, 1, 2))
    rest = F.substring(body, 3, 1 << 30)
    utf16 = F.when(mark == "FEFF", _utf16(rest, True)).when(mark == "FFFE", _utf16(rest, False)).otherwise(_utf16(body, False))
    return (
        F.when(name == "utf_8", utf8)
        .when(name == "utf_8_sig", F.regexp_replace(utf8, "^﻿", ""))
        .when(name == "utf_16_le", _utf16(body, False))
        .when(name == "utf_16_be", _utf16(body, True))
        .when(name == "utf_16", utf16)
        .otherwise(bind(_lookup(name, _TABLES), lambda pair: F.when(pair.isNotNull(), single(pair))))
    )


def is_multibyte(name: Column) -> Column:
    return F.coalesce(name.isin(*_SEVERAL), F.lit(False))


def decode_multibyte(body: Column, name: Column) -> Column:
    """Text of ``body`` in one of the charsets that ``is_multibyte`` names."""

    def decoded(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or c is None else bytes(b).decode(c, "replace") for b, c in zip(bodies, names)], dtype=object)

    return F.pandas_udf(decoded, StringType())(body, name)
