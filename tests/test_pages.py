"""Article extraction on hand-written pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import pages as P

PARA = "This paragraph has enough words to pass the block length gate easily. "
PAGE = f"""<!doctype html><html><head><title>Fallback &amp;amp; title</title>
<meta property="og:title" content="OG &amp; Title"><meta name="author" content="Ann Author">
<meta property="article:published_time" content="2024-01-05"><meta property="og:site_name" content="Site">
<script>var x = "</p><p>not text</p>";</script><style>p{{x:1}}</style></head>
<body><nav><a href="/">Home</a></nav><div class="cookie-banner">Accept cookies please, this is long enough.</div>
<div class="sidebar menu">{PARA * 3}</div>
<article class="post"><h1>Head</h1><p>One. {PARA * 12}</p><p>Two. {PARA * 12}</p><p>short</p><p>One. {PARA * 12}</p><p>Three. {PARA * 12}</p>
<div class="share-tools"><p>Share this article on every network you know about.</p></div></article>
<footer>Footer text that is long enough to be a block.</footer></body></html>"""


def _extract(spark, url, html, ct="text/html", fetch="ok"):
    df = spark.createDataFrame([(1, url, html, ct, fetch)], "page_id long, url string, html string, content_type string, fetch_status string")
    return P.extract_articles(df).collect()[0]


def test_extract_article(spark):
    a = _extract(spark, "https://Ex.org/a", PAGE)
    assert a["status"] == "ok" and a["ok"]
    assert a["title"] == "OG & Title" and a["byline"] == "Ann Author" and a["site_name"] == "Site"
    assert a["published_date"] == "2024-01-05"
    assert a["text"].startswith("Head\n\n")
    assert "not text" not in a["text"] and "Share this" not in a["text"] and "cookies" not in a["text"]
    assert a["text"].count(PARA.strip()[:30]) == 36 and "short" not in a["text"]
    assert a["content_chars"] == len(a["text"])


def test_status_ladder(spark):
    assert _extract(spark, "ftp://x/a", PAGE)["status"] == "unsupported-url"
    assert _extract(spark, "https://x/a", PAGE, fetch="timeout")["error"] == "Timed out after 20s"
    assert _extract(spark, "https://x/a", PAGE, ct="application/pdf")["status"] == "non-html"
    assert _extract(spark, "https://x/a", PAGE, ct="")["status"] == "ok"
    short = _extract(spark, "https://x/a", "<html><body><p>tiny text only here</p></body></html>")
    assert short["status"] == "too-short" and not short["ok"] and short["text"] == "tiny text only here" and short["site_name"] == "x"
    nothing = _extract(spark, "https://x/a", None)
    assert nothing["status"] == "fetch-error" and not nothing["ok"] and nothing["text"] == ""


def test_decode_page_charsets(spark):
    rows = [("é–x".encode("cp1252"), "text/html; charset=windows-1252"), ("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (b"a\xffb", "text/html"), ("é".encode("utf-16-le"), "x; charset=utf-16le"), (b"x", "x; charset=klingon")]
    df = spark.createDataFrame([(bytearray(b), c) for b, c in rows], "b binary, c string")
    assert [r.t for r in df.select(P.decode_page(F.col("b"), F.col("c")).alias("t")).collect()] == ["é–x", "é", "a\ufffdb", "é", None]


def test_fixture_drives_every_status(spark):
    from gleaner.functions import constants as C
    from gleaner.plans import fixtures as X
    from tests.conftest import SF001

    raw = X.pages_raw(spark, SF001).withColumn("html", F.when(F.col("page_id") % 5 == 0, "<p>short</p>").otherwise(F.col("html")))
    got = {r.status for r in P.extract_articles(raw).select("status").distinct().collect()}
    assert got == set(C.EXTRACTION_STATUSES)


def test_a_page_task_is_bounded_by_its_bytes(spark):
    from gleaner.operators.partitioning import spread

    pages = spark.createDataFrame([(i, "x" * 1000 if i % 5 else None) for i in range(100)], "page_id int, html string").repartition(20)
    assert spread(pages, 2).rdd.getNumPartitions() == 20
    cut = spread(pages, 2, heavy="html", task_bytes=2000)
    assert cut.rdd.getNumPartitions() == 40 and sorted(r.page_id for r in cut.collect()) == list(range(100))
    assert spread(pages.limit(0), 3, heavy="html").rdd.getNumPartitions() <= 3
    assert spread(pages, 2, heavy="html").rdd.getNumPartitions() == 20
