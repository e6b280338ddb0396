"""Element trees, noise, entities and texts of pages against a tree built by the standard library's parser."""

from __future__ import annotations

import html as stdlib_html
import random
import re
import time
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions import html as H
from gleaner.functions.text import clean_whitespace, html_unescape
from gleaner.operators import pages as P
from tests.conftest import many

LONG = "This sentence is long enough to count as a block of its own. " * 14


class Tree(HTMLParser):
    """Elements as [name, attributes, children]; a close tag ends the nearest open element of its name."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.running = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.running = False
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in C.VOID_TAGS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.running = False
        self.stack[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        self.running = False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        into = self.stack[-1][2]
        if self.running:  # data comes in pieces; a run of text is one string
            into[-1] += data
        else:
            into.append(data)
        self.running = True


def walk(node):
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from walk(child)


def strings(node):
    for child in node[2]:
        if isinstance(child, str):
            yield child
        else:
            yield from strings(child)


def said(node, sep):
    text = stdlib_html.unescape(sep.join(s.strip() for s in strings(node) if s.strip())).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()


def random_page(rng: random.Random) -> str:
    names = ["div", "p", "li", "ul", "b", "h2", "article", "section", "a", "br", "img"]
    words = ["one", "two &amp; more", "&eacute;t&eacute;", "a < b", "x &rarr; y", " ", "\n"]
    out = []
    for _ in range(rng.randint(0, 40)):
        n = rng.choice(names)
        attrs = rng.choice(["", "", " class=main", ' title="a > b"', " id='x'", " class='a content b'", " data-x"])
        out.append(rng.choice([f"<{n}{attrs}>", f"</{n}>", f"<{n}{attrs}/>", rng.choice(words), rng.choice(words)]))
    return "".join(out)


def test_elements_and_texts_equal_a_tree(spark):
    rng = random.Random(6)
    pages = [random_page(rng) for _ in range(400)] + ["", "</p>", "<p>" * 50, "text only", "<b>a<i>b</b>c</i>d"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, x string")
    df = df.withColumn("e", H.elements(F.col("x"))).withColumn("r", H.text_runs(F.col("x")))
    texts = H.bind(F.struct("e", "r"), lambda s: F.transform(s["e"], lambda e: F.struct(e["name"], H.element_text(s["r"], e, " "))))
    for row in df.select("i", texts.alias("t"), H.joined_text(F.col("r"), "\n").alias("whole")).collect():
        tree = Tree(pages[row.i]).root
        assert [tuple(t) for t in row.t] == [(n[0], said(n, " ")) for n in walk(tree)], pages[row.i]
        assert row.whole == said(tree, "\n"), pages[row.i]


def test_offsets_cut_whole_elements(spark):
    page = "<div class='a>b'><p>x<b>y</p></div>z<li>o<ul><li>i</li></ul></li>"
    (row,) = spark.createDataFrame([(page,)], "x string").select(H.elements(F.col("x")).alias("e")).collect()
    assert [page[e.start - 1 : e.end - 1] for e in row.e] == [
        "<div class='a>b'><p>x<b>y</p></div>", "<p>x<b>y</p>", "<b>y", "<li>o<ul><li>i</li></ul></li>", "<ul><li>i</li></ul>", "<li>i</li>",
    ]


def _article(spark, body, head=""):
    page = f"<html><head>{head}</head><body>{body}</body></html>"
    df = spark.createDataFrame([("https://x/a", page, "text/html", "ok")], "url string, html string, content_type string, fetch_status string")
    return P.extract_articles(df).collect()[0]


def test_containers_end_at_their_own_close_tag(spark):
    a = _article(spark, f'<div class="content"><div><p>A short introduction stands here.</p></div><p>{LONG}</p></div>')
    assert a.status == "ok" and a.text == f"A short introduction stands here.\n\n{LONG.strip()}"


def test_noise_on_any_tag_quoted_or_not(spark):
    noisy = [
        '<h2 class="newsletter">Gone one, with enough words</h2>', "<p class=newsletter>Gone two, with enough words</p>",
        '<p aria-label="Don\'t share this">Gone three, with enough words</p>', "<custom-box id='x' role=PROMO><p>Gone four, with enough words</p></custom-box>",
        "<p title='y\">' class='a &#115;ocial b'>Gone five, with enough words</p>", "<form><p>Gone six, in a form</p><form>nested</form>still gone, all of it</form>",
    ]
    a = _article(spark, "".join(noisy) + f'<div title="x > y"><p>{LONG}</p></div>')
    assert a.text == LONG.strip()


def test_unquoted_metadata(spark):
    head = "<title>No</title><meta property=og:title content=Hello><meta content='Ann &amp; Bob' name=author><META NAME=date CONTENT=2024-02-03>"
    a = _article(spark, f"<p>{LONG}</p>", head)
    assert (a.title, a.byline, a.published_date) == ("Hello", "Ann & Bob", "2024-02-03")
    a = _article(spark, f"<p>{LONG}</p><a rel=author href=/x>By <b>Eve</b></a><time datetime>March</time>", "<title> A &eacute; <b>t</title>")
    assert (a.title, a.byline, a.published_date) == ("A é t", "By Eve", "March") or (a.title, a.byline) == ("A é <b>t", "By Eve")


def test_nested_blocks_give_outer_and_inner(spark):
    inner = "inner text that is long enough"
    a = _article(spark, f"<article><ul><li>outer text, also long enough<ul><li>{inner}</li></ul></li></ul><p>{LONG}</p></article>")
    assert a.text.split("\n\n")[:2] == [f"outer text, also long enough {inner}", inner]


def test_every_named_reference(spark):
    names = list(html5)
    texts = [f"a&{n}b &{n}" for n in names] + ["&notit; &amp;amp; &foo; & &; &#; &#x0D;&#13; &#x7f; &#xfffe; &#129;", "&#99999999999; &#00065;"]
    assert many(spark, html_unescape(F.col("x")), texts) == [stdlib_html.unescape(t) for t in texts]
    assert many(spark, clean_whitespace(F.col("x")), ["&eacute; &rarr;&times;&nbsp;x"]) == ["é →× x"]


def test_fallback_containers_have_a_limit(spark):
    page = f"<div><p>one</p></div><div><p>{LONG}</p></div>"
    df = spark.createDataFrame([("https://x/a", page)], "url string, html string")
    size = lambda n: P.extract_stages(df, max_containers=n).select(F.size("x_scored").alias("n"), "x_main").collect()[0]
    assert size(200).n == 2 and size(1).n == 1 and size(1).x_main != size(200).x_main


def test_block_dedup_is_linear_and_keeps_first(spark):
    def blocks(n):
        return spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit("p").alias("tag"), F.concat(F.lit("Text "), (i % (n // 2)).cast("string")).alias("text"))).alias("b"))

    got = blocks(8).select(H.dedup_blocks(F.col("b")).alias("d")).collect()[0].d
    assert [b.text for b in got] == ["Text 1", "Text 2", "Text 3", "Text 0"]
    mixed = spark.createDataFrame([([("p", "One"), ("h1", "two"), ("p", "ONE"), ("p", "Two"), ("p", "three")],)], "b array<struct<tag:string,text:string>>")
    assert [tuple(b) for b in mixed.select(H.dedup_blocks(F.col("b")).alias("d")).collect()[0].d] == [("p", "One"), ("h1", "two"), ("p", "three")]

    def seconds(n):
        df = blocks(n).checkpoint()
        started = time.time()
        df.select(F.size(H.dedup_blocks(F.col("b")))).collect()
        return time.time() - started

    seconds(1000)
    assert seconds(32_000) < 40 * max(seconds(4000), 0.05)
