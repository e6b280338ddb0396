"""Decoding of landed bytes against the standard library's codecs."""

from __future__ import annotations

import codecs
import random

from pyspark.sql import functions as F

from gleaner.functions import charsets
from gleaner.operators import pages as P


def _decoded(spark, rows):
    df = spark.createDataFrame([(i, bytearray(b), c) for i, (b, c) in enumerate(rows)], "i int, body binary, content_type string")
    return [r.html for r in P.decode_pages(df).orderBy("i").collect()]


def _known(name):
    try:
        codecs.lookup(name)
        return True
    except LookupError:
        return False


def test_every_charset_equals_its_codec(spark):
    rng = random.Random(1)
    names = sorted({*charsets._NAMES, "ISO_646.irv:1991", "ANSI_X3.4-1968", "windows-1251", "ISO-8859-15", "GB2312", "Shift_JIS", "big5", "EUC-KR", "koi8-r", "UTF-32", "utf-7"})
    names = [n for n in names if _known(n)]
    assert len(names) > 300
    rows = [(bytes(range(256)) if n in charsets._TABLES else rng.randbytes(60), f"text/html; Charset={n} ; x") for n in names]
    assert _decoded(spark, rows) == [b.decode(c.split("=")[1].split(";")[0].strip(), "replace") for b, c in rows]


def test_malformed_utf16_never_fails(spark):
    rng = random.Random(2)
    units = [b"\xd8\x00", b"\xdc\x01", b"\x00a", b"\x20\xac", b"\xdb\xff", b"\xdf\xff", b"\xff\xfe", b"\xfe\xff"]
    bodies = [b"".join(rng.choice(units) for _ in range(rng.randint(0, 9))) + rng.choice([b"", b"\xd8", b"a"]) for _ in range(400)]
    for name in ("utf-16", "utf-16le", "UTF-16BE"):
        assert _decoded(spark, [(b, f"charset={name}") for b in bodies]) == [b.decode(name, "replace") for b in bodies]


def test_malformed_utf8_and_unknown_charsets(spark):
    rng = random.Random(3)
    bodies = [rng.randbytes(12) for _ in range(200)] + [b"a\xffb", "é".encode()[:1], b"\xe2\x82"]
    assert _decoded(spark, [(b, "text/html") for b in bodies]) == [b.decode("utf-8", "replace") for b in bodies]
    rows = [(b"\xef\xbb\xbfx", "charset=utf-8-sig"), (b"x", "x; charset=klingon"), (b"x", 'charset="latin1"'), (b"x", "charset=rot13")]
    assert _decoded(spark, rows) == ["x", None, "x", None]


def test_unknown_charset_is_a_fetch_error_with_its_name(spark):
    row = [(1, "https://x/a", bytearray(b"<p>a</p>"), "text/html; charset=Klingon", "ok")]
    df = spark.createDataFrame(row, "page_id long, url string, body binary, content_type string, fetch_status string")
    a = P.extract_articles(P.decode_pages(df)).collect()[0]
    assert (a.status, a.error, a.ok) == ("fetch-error", "unknown encoding: Klingon", False)


def test_the_byte_cap_may_cut_a_character(spark):
    df = spark.createDataFrame([(bytearray("aé€".encode()),)], "b binary")
    got = df.select(*[P.decode_page(F.col("b"), F.lit(None).cast("string"), n).alias(str(n)) for n in range(1, 7)]).collect()[0]
    assert list(got) == ["aé€".encode()[:n].decode("utf-8", "replace") for n in range(1, 7)]
