"""HTML article extraction as column expressions over one page's markup.

A page is one row and stays one: extraction is a narrow map without a shuffle, bounded
by the page cap. It works in three steps, all in array functions:

* ``tokens``: the page is cut at its tags by one pattern (quoted attribute values may
  hold ``>``).
* ``elements``: one fold over the tag tokens keeps the stack of open elements. A close
  tag ends the nearest open element of its name, and with it all elements opened since;
  a close tag without one counts for nothing; what is open at the end of the page ends
  there. Every element comes out with its offsets in the page and the numbers of its
  tags.
* Texts are joined from the runs of text between an element's tags, each decoded and
  stripped once per page; spans of markup are cut out by offset.

Comments, declarations, scripts and styles are replaced by the mark ``<!>`` beforehand,
as are removed elements later, so that the texts on both sides stay apart.

Expressions that a lambda uses are bound to lambda variables (``bind``): the optimizer
would otherwise copy them into the lambda, where they run once per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import constants as C
from gleaner.functions.text import clean_whitespace, html_unescape, py_strip

CUT = "<!>"
#: what is no markup: comments, whole scripts and styles, declarations
RAW_RE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)|<[!?][^>]*>"
#: a tag, with quoted attribute values; one with an open quote ends at the first ``>``
TAG_RE = r"(?s)</?[a-zA-Z][^\s/>]*(?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+>|</?[a-zA-Z][^>]*>|<!>"
TAG_NAME_RE = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE_RE = r"(?s)([^\s/>=\"'][^\s/>=]*)(?:\s*=+\s*(\"[^\"]*\"|'[^']*'|[^>\s\"'][^>\s]*|))?"
ELEMENT = "struct<start:int,cstart:int,cend:int,end:int,i:int,j:int,name:string,tag:string>"
BLOCK = "array<struct<tag:string,text:string>>"
FOLD_BLOCK = 128


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Fold ``items``; ``step(state, item)`` gives struct(state, out) and all ``out`` arrays are
    joined: struct(state, out: array<kind>). Items are folded in blocks, so that joining
    copies an output once per block and not once per item."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, item):
        return bind(step(acc["state"], item), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], s["out"]).alias("out")))

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(inner, lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], s["out"]).alias("out")))

    def folded(all_):
        n = F.ceil(F.size(all_) / FOLD_BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda b: F.slice(all_, (b - 1) * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))
        return F.aggregate(parts, F.struct(state.alias("state"), none.alias("out")), block)

    return bind(items, folded)


def without_raw(html: Column) -> Column:
    return F.regexp_replace(html, RAW_RE, CUT)


def tag_tokens(page: Column) -> Column:
    """array<struct<before:int, length:int, name:string, kind:string, tag:string>>: every tag with the
    length of the text before it. Kinds: open, close, empty (void or closed by itself), none."""

    def token(t):
        name = F.lower(F.regexp_extract(t["tag"], TAG_NAME_RE, 1))
        closed = F.endswith(t["tag"], F.lit("/>")) & ~t["tag"].rlike(r"=[^\s\"'>]*/>$")
        return bind(name, lambda n: F.struct(
            F.length(t["part"]).alias("before"), F.length(t["tag"]).alias("length"), n.alias("name"),
            F.when(t["tag"] == CUT, "none").when(F.startswith(t["tag"], F.lit("</")), "close")
            .when(n.isin(*C.VOID_TAGS) | closed, "empty").otherwise("open").alias("kind"),
            t["tag"].alias("tag"),
        ))

    tags = F.regexp_extract_all(page, F.lit(TAG_RE), 0)
    both = bind(tags, lambda t: F.arrays_zip(F.slice(F.split(page, TAG_RE, -1), F.lit(1), F.size(t)).alias("part"), t.alias("tag")))
    return F.transform(both, token)


def elements(page: Column) -> Column:
    """Every element of a page, in order of its open tag: array<ELEMENT>.

    ``start`` and ``end`` are the 1-based offsets of the element and of what follows it,
    ``cstart`` and ``cend`` those of its content; its tags are tokens ``i`` and ``j``."""
    none = F.array().cast(f"array<{ELEMENT}>")
    as_int = lambda c, name: c.cast("int").alias(name)

    def element(e, cend, end, j):
        return F.struct(e["start"].alias("start"), e["cstart"].alias("cstart"), as_int(cend, "cend"), as_int(end, "end"), e["i"].alias("i"), as_int(j, "j"), e["name"].alias("name"), e["tag"].alias("tag"))

    def step(st, t):
        start = st["pos"] + t["before"]
        after = start + t["length"]
        zero = F.lit(0)
        new = F.struct(as_int(start, "start"), as_int(after, "cstart"), as_int(zero, "cend"), as_int(zero, "end"), st["k"].alias("i"), as_int(zero, "j"), t["name"].alias("name"), t["tag"].alias("tag"))

        def moved(stack):
            return F.struct(as_int(after, "pos"), as_int(st["k"] + 1, "k"), stack.alias("stack"))

        def closed(depth):
            keep = F.size(st["stack"]) - depth
            out = F.transform(F.slice(st["stack"], keep + 1, depth), lambda e, x: element(e, start, F.when(x == 0, after).otherwise(start), st["k"]))
            return F.struct(moved(F.slice(st["stack"], F.lit(1), keep)).alias("state"), out.alias("out"))

        depth = F.array_position(F.reverse(F.transform(st["stack"], lambda e: e["name"])), t["name"]).cast("int")
        same = F.struct(moved(st["stack"]).alias("state"), none.alias("out"))
        return (
            F.when(t["kind"] == "open", F.struct(moved(F.concat(st["stack"], F.array(new))).alias("state"), none.alias("out")))
            .when(t["kind"] == "close", bind(depth, lambda d: F.when(d > 0, closed(d)).otherwise(same)))
            .when(t["kind"] == "empty", F.struct(moved(st["stack"]).alias("state"), F.array(element(new, after, after, st["k"])).alias("out")))
            .otherwise(same)
        )

    state = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("k"), none.alias("stack"))
    length = F.length(page) + 1
    return bind(
        scan(tag_tokens(page), state, step, ELEMENT),
        lambda s: F.array_sort(F.concat(s["out"], F.transform(s["state"]["stack"], lambda e: element(e, length, length, s["state"]["k"])))),
    )


def attribute(tag: Column, name: Column) -> Column:
    """Value of an open tag's attribute (the last of that name; '' if it has no value, null if it is absent)."""
    rest = F.regexp_replace(F.regexp_replace(tag, TAG_NAME_RE, ""), r"/?>\z", "")

    def value(r):
        names = F.transform(F.regexp_extract_all(r, F.lit(ATTRIBUTE_RE), 1), F.lower)
        at = F.array_position(F.reverse(names), name).cast("int")

        def found(a):
            raw = F.element_at(F.reverse(F.regexp_extract_all(r, F.lit(ATTRIBUTE_RE), 2)), a)
            return F.when(a > 0, html_unescape(F.regexp_replace(raw, r"(?s)\A([\"'])(.*)\1\z", "$2")))

        return bind(at, found)

    return bind(rest, value)


def attributes(tag: Column, names: list[str]) -> Column:
    """The values of several attributes, joined by blanks; absent ones are left out."""
    return F.array_join(F.transform(F.array(*map(F.lit, names)), lambda n: attribute(tag, n)), " ")


def text_runs(page: Column) -> Column:
    """The runs of text before, between and after a page's tags, decoded and stripped."""
    return F.transform(F.split(page, TAG_RE, -1), lambda t: py_strip(html_unescape(t)))


def element_text(runs: Column, e: Column, sep: str) -> Column:
    """The text of element ``e``: its runs that are not empty, joined, then cleaned."""
    return joined_text(F.slice(runs, e["i"] + 2, e["j"] - e["i"]), sep)


def joined_text(runs: Column, sep: str) -> Column:
    return clean_whitespace(F.array_join(F.filter(runs, lambda t: t != ""), sep))


def is_noise(tag: Column) -> Column:
    """Whether an open tag's id, class, role or aria-label holds a noise word."""
    values = attributes(tag, C.NOISE_ATTRIBUTES)
    # an attribute that holds such a word holds it as written, or as references
    may = tag.rlike("(?i)" + C.NOISE_ATTRIBUTE_PATTERN + "|&")
    return F.when(may, values.rlike("(?i)" + C.NOISE_ATTRIBUTE_PATTERN)).otherwise(False)


def without_elements(page: Column, removed: Column) -> Column:
    """The page without the given elements (in order of their starts), a mark in the place of each."""

    def cut(p):
        def step(st, e):
            piece = F.substring(p["page"], st["at"], e["start"] - st["at"])
            inside = e["start"] < st["at"]
            return F.struct(
                F.struct(F.when(inside, st["at"]).otherwise(e["end"]).alias("at")).alias("state"),
                F.when(inside, F.array().cast("array<string>")).otherwise(F.array(piece)).alias("out"),
            )

        done = scan(p["removed"], F.struct(F.lit(1).alias("at")), step, "string")
        return bind(done, lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(p["page"], s["state"]["at"], F.length(p["page"])))), CUT))

    return bind(F.struct(page.alias("page"), removed.alias("removed")), cut)


def without_boilerplate(page: Column, els: Column) -> Column:
    return without_elements(page, F.filter(els, lambda e: e["name"].isin(*C.BOILERPLATE_TAGS) | is_noise(e["tag"])))


def has_class(e: Column, token: Column) -> Column:
    gate = F.contains(e["tag"], token) | F.contains(e["tag"], F.lit("&"))
    classes = F.split(attribute(e["tag"], F.lit("class")), r"\s+")
    return F.when(gate, F.coalesce(F.array_position(classes, token) > 0, F.lit(False))).otherwise(False)


def preferred_candidates(els: Column) -> Column:
    """Containers matched by the preferred selectors, selector order then document order.

    "main article" matches are a subset of "article" matches listed before, so they
    can never change a first-wins arg-max and are not repeated.
    """
    classes = F.array(*(F.lit(s[1:]) for s in C.PREFERRED_CONTAINER_SELECTORS[4:]))
    main = lambda e: F.when(F.contains(e["tag"], F.lit("main")), F.coalesce(attribute(e["tag"], F.lit("role")) == "main", F.lit(False))).otherwise(False)
    return F.concat(
        F.filter(els, lambda e: e["name"] == "article"), F.filter(els, lambda e: e["name"] == "main"), F.filter(els, main),
        F.flatten(F.transform(classes, lambda c: F.filter(els, lambda e: has_class(e, c)))),
    )


def fallback_candidates(els: Column, limit: int = C.MAX_FALLBACK_CONTAINERS) -> Column:
    return F.slice(F.filter(els, lambda e: e["name"].isin(*C.FALLBACK_CONTAINER_TAGS)), F.lit(1), F.lit(limit))


def measured(els: Column, runs: Column) -> Column:
    """array<struct<start, name, len>> of paragraphs, headings and links, with the lengths that scores need."""
    wanted = F.filter(els, lambda e: e["name"].isin("p", "a", *C.HEADING_TAGS))
    counted = lambda r: F.transform(wanted, lambda e: F.struct(
        e["start"].alias("start"), e["name"].alias("name"),
        F.when(e["name"].isin("p", "a"), F.length(element_text(r, e, " "))).otherwise(0).alias("len"),
    ))
    return bind(runs, counted)


def container_score(c: Column, inner: Column, runs: Column) -> Column:
    """A candidate with its measures and score; ``inner`` are the page's measured elements."""

    def scored(m):
        def total(name):
            return F.aggregate(F.filter(m["inner"], lambda e: e["name"] == name), F.lit(0), lambda a, e: a + e["len"])

        n_p = F.size(F.filter(m["inner"], lambda e: e["name"] == "p"))
        n_h = F.size(F.filter(m["inner"], lambda e: e["name"].isin(*C.HEADING_TAGS)))
        return bind(F.struct(total("p").alias("para_len"), total("a").alias("link_len"), n_p.alias("n_p"), n_h.alias("n_h")), lambda t: final(m, t))

    def final(m, t):
        score = (
            m["text_len"] + t["para_len"] + t["n_p"] * 80 + t["n_h"] * 40
            - F.when(m["text_len"] > 0, (t["link_len"] / m["text_len"] * 600).cast("int")).otherwise(F.lit(0))
            + F.when(m["attrs"].rlike("(?i)" + C.POSITIVE_CONTAINER_PATTERN), F.lit(800)).otherwise(F.lit(0))
            - F.when(m["attrs"].rlike("(?i)" + C.NEGATIVE_CONTAINER_PATTERN), F.lit(1000)).otherwise(F.lit(0))
        )
        return F.struct(
            *[c[f].alias(f) for f in ("name", "i", "j", "cend")], c["cstart"].alias("start"), m["text_len"].alias("text_len"),
            *[t[f].alias(f) for f in ("para_len", "n_p", "n_h", "link_len")], score.cast("int").alias("score"),
        )

    measures = F.struct(
        F.length(element_text(runs, c, "\n")).alias("text_len"),
        F.filter(inner, lambda e: (e["start"] >= c["cstart"]) & (e["start"] < c["cend"])).alias("inner"),
        attributes(c["tag"], ["id", "class", "role"]).alias("attrs"),
    )
    return bind(measures, scored)


def scored_candidates(candidates: Column, inner: Column, runs: Column) -> Column:
    page = F.struct(candidates.alias("c"), inner.alias("inner"), runs.alias("runs"))
    return bind(page, lambda p: F.transform(p["c"], lambda c: container_score(c, p["inner"], p["runs"])))


def best_candidate(scored: Column) -> Column:
    """First candidate with the maximum score (null when there are none)."""
    first = F.try_element_at(scored, F.lit(1))
    return F.when(F.size(scored) == 0, F.lit(None)).otherwise(
        F.aggregate(F.slice(scored, 2, 1 << 30), first, lambda best, c: F.when(c["score"] > best["score"], c).otherwise(best))
    )


def block_texts(els: Column, runs: Column, container: Column) -> Column:
    """(tag, text) of every block element inside a container, outer before inner, each with its whole text."""

    def blocks(p):
        inside = lambda e: e["name"].isin(*C.BLOCK_TAGS) & (e["start"] >= p["c"]["start"]) & (e["start"] < p["c"]["cend"])
        return F.transform(F.filter(p["els"], inside), lambda e: F.struct(e["name"].alias("tag"), element_text(p["runs"], e, " ").alias("text")))

    return bind(F.struct(els.alias("els"), runs.alias("runs"), container.alias("c")), blocks)


def keep_block(b: Column) -> Column:
    return (F.length(b["text"]) >= C.MIN_BLOCK_CHARS) | b["tag"].isin(*C.HEADING_TAGS)


def dedup_blocks(blocks: Column) -> Column:
    """First occurrence of each lower-cased block text, order kept: sorted by (text, place), where
    equal texts are neighbours, and back."""
    keyed = F.sort_array(F.transform(blocks, lambda b, i: F.struct(F.lower(b["text"]).alias("key"), i.alias("i"), b.alias("b"))))
    firsts = bind(keyed, lambda k: F.filter(k, lambda x, n: (n == 0) | (x["key"] != F.get(k, n - 1)["key"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["b"].alias("b")))), lambda x: x["b"])


def fragment_text(fragment: Column, sep: str) -> Column:
    """The text of a piece of markup."""
    return joined_text(text_runs(fragment), sep)


def selected(els: Column, s: Column) -> Column:
    """The first element that a selector struct(element, attribute, value) asks for (null parts ask for nothing)."""

    def wanted(e):
        # a value is found in the tag as written, unless it holds references
        gate = F.contains(e["tag"], F.coalesce(s["value"], F.lit(""))) | F.contains(e["tag"], F.lit("&"))
        has = bind(attribute(e["tag"], s["attribute"]), lambda v: F.coalesce(v.eqNullSafe(s["value"]) | (s["value"].isNull() & v.isNotNull()), F.lit(False)))
        return F.coalesce(e["name"] == s["element"], F.lit(True)) & F.when(s["attribute"].isNull(), True).when(gate, has).otherwise(False)

    return F.try_element_at(F.filter(els, wanted), F.lit(1))


def content_or_text(page: Column, e: Column) -> Column:
    """What an element says: its content attribute, or its text ('' if neither)."""

    def of(content):
        text = joined_text(text_runs(F.substring(page, e["cstart"], e["cend"] - e["cstart"])), " ")
        return F.when(content != "", clean_whitespace(content)).otherwise(text)

    return F.when(e.isNull(), "").otherwise(bind(F.coalesce(attribute(e["tag"], F.lit("content")), F.lit("")), of))


def selected_texts(page: Column, els: Column, selectors: list[tuple]) -> Column:
    """array<string>: what the first element of every (element, attribute, value) selector says."""
    asked = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("element", "attribute", "value"), s))) for s in selectors))
    found = bind(els, lambda all_: F.transform(asked, lambda s: selected(all_, s)))
    return bind(page, lambda p: F.transform(found, lambda e: content_or_text(p, e)))
