"""Sources and sinks on files: RSS/Atom, feed config, topics, seen JSON, writers."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from gleaner.operators import discovery as D
from gleaner.sources import feeds as FS

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>C</title>
<item><title>First &amp; best</title><link>https://a.org/1?utm_source=x</link><description><![CDATA[<p>Hi</p>]]></description>
<category>ai</category><category>llm</category><pubDate>Fri, 05 Jan 2024 03:04:05 +0100</pubDate></item>
<item><title>No link</title><description>d</description></item>
<item><link>https://a.org/3</link><pubDate>31 Feb 2024 00:00:00 GMT</pubDate></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title>E1</title><link rel="alternate" href="https://b.org/e1"/><summary>S</summary><category term="k8s"/>
<updated>2024-01-05T03:04:05Z</updated></entry>
<entry><title>E2</title><link href="https://b.org/e2"/><published>2024-01-06T10:00:00+02:00</published></entry>
</feed>"""


def _tmp():
    return tempfile.mkdtemp(prefix="gleaner-test-")


def test_rss_and_atom_files(spark):
    d = _tmp()
    with open(os.path.join(d, "a.xml"), "w") as f:
        f.write(RSS)
    rss = FS.read_feed_files(spark, os.path.join(d, "a.xml"), "rss").collect()
    assert [r["link"] for r in rss] == ["https://a.org/1?utm_source=x", None, "https://a.org/3"]
    assert rss[0]["title"] == "First & best" and rss[0]["summary"] == "<p>Hi</p>" and rss[0]["terms"] == ["ai", "llm"]
    assert rss[0]["published"] == dt.datetime(2024, 1, 5, 2, 4, 5)
    assert rss[2]["published"] is None  # impossible date -> NULL, batch survives
    d2 = _tmp()
    with open(os.path.join(d2, "b.xml"), "w") as f:
        f.write(ATOM)
    atom = FS.read_feed_files(spark, os.path.join(d2, "b.xml"), "atom").collect()
    assert [r["link"] for r in atom] == ["https://b.org/e1", "https://b.org/e2"]
    assert atom[0]["updated"] == dt.datetime(2024, 1, 5, 3, 4, 5) and atom[0]["terms"] == ["k8s"]
    assert atom[1]["published"] == dt.datetime(2024, 1, 6, 8, 0, 0)


def test_feed_config_topics_seen(spark):
    d = _tmp()
    cfg = os.path.join(d, "feeds.json")
    with open(cfg, "w") as f:
        json.dump({"feeds": [{"name": "A", "url": "u", "tags": ["ai"], "weight": 0.29}]}, f, indent=2)
    rows = FS.read_feed_config(spark, cfg).collect()
    assert rows[0]["name"] == "A" and rows[0]["weight"] == 0.29
    assert FS.read_feed_config(spark, os.path.join(d, "missing.json")).count() == 0
    topics = os.path.join(d, "topics.txt")
    with open(topics, "w") as f:
        f.write("# comment\n\nAI agents\n  #kept\n  spaced topic  \nAI agents\n")
    got = [r["topic"] for r in FS.read_topics(spark, topics).orderBy("pos").collect()]
    assert got == ["AI agents", "#kept", "spaced topic", "AI agents"]
    seen = os.path.join(d, "seen.json")
    with open(seen, "w") as f:
        json.dump({"https://a.org/x": {"first_seen": "t0", "last_seen": "t1", "title": "T", "source": "S", "published": ""}}, f, indent=2, sort_keys=True)
    s = FS.read_seen_json(spark, seen).collect()
    assert s[0]["url"] == "https://a.org/x" and s[0]["last_seen"] == "t1"
    assert FS.read_seen_json(spark, os.path.join(d, "none.json")).count() == 0


def test_writers_roundtrip(spark):
    from gleaner.sinks import writers as W

    d = _tmp()
    rows = spark.createDataFrame([("t", "2024-01-01", 1), ("t", "2024-01-02", 2), ("t", "2024-01-02", 3), ("u", "2024-01-01", 4)],
                                 "topic string, run_date string, pos int")
    W.write_archive(rows, os.path.join(d, "arch"))
    W.write_archive(rows.where("run_date = '2024-01-02'").limit(1), os.path.join(d, "arch"))  # replaces only that date
    latest = {r["topic"]: (r["latest_run_date"], r["n_articles"]) for r in W.latest_archive(spark, os.path.join(d, "arch")).collect()}
    assert latest == {"t": ("2024-01-02", 1), "u": ("2024-01-01", 1)}
    lines = spark.createDataFrame([("t", 0, 0, i, f"line {i}") for i in range(50)], "topic string, block int, item long, line int, text string")
    W.write_digest(lines.repartition(7), os.path.join(d, "digest"))
    back = spark.read.text(os.path.join(d, "digest", "topic=t")).collect()
    assert len(back) == 50
    _ = F


def test_recent_and_manual_and_scorer(spark):
    from gleaner.operators import analysis as A

    d = _tmp()
    p = os.path.join(d, "recent.json")
    with open(p, "w") as f:
        json.dump(["a", "b", "a"], f, indent=2)
    assert [(r["pos"], r["topic"]) for r in FS.read_recent(spark, p).orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "a")]
    assert FS.read_recent(spark, os.path.join(d, "nope.json")).count() == 0
    urls = spark.createDataFrame([("https://x.org/a",)], "url string")
    art = A.articles_from_urls(urls).collect()[0]
    assert art["title"] == art["url"] and art["content"].startswith("Manual URL submission.")
    prompts = spark.createDataFrame([("u1", "p1"), ("u2", "p2")], "url string, prompt string")
    out = A.score_with(prompts, lambda s: s.map(lambda x: '{"recommendation": "skim", "signal_score": 90}' if x == "p1" else "garbage"))
    got = {r["url"]: r["analysis"] for r in out.collect()}
    assert got["u1"]["recommendation"] == "skim" and got["u1"]["signal_score"] == 90
    assert got["u2"]["analysis_error"] is not None


def test_feed_dates_with_zone_names_short_years_and_plain_dates(spark):
    golden = {
        "Tue, 02 Jan 2024 10:00:00 EST": "2024-01-02 15:00:00",
        "Tue, 02 Jul 2024 10:00:00 PDT": "2024-07-02 17:00:00",
        "02 Jan 24 9:05 GMT": "2024-01-02 09:05:00",
        "Sat, 02 Jan 99 09:05:07 +0100": "1999-01-02 08:05:07",
        "2024-01-02": "2024-01-02 00:00:00",
        "2024-01-02T10:00+02:00": "2024-01-02 08:00:00",
        "Tue, 02 Jan 2024 10:00:00 XYZ": None,
        "yesterday": None,
    }
    df = spark.createDataFrame([(i, s) for i, s in enumerate(golden)], "i int, s string")
    got = [r.t for r in df.orderBy("i").select(FS.parse_feed_date("s").cast("string").alias("t")).collect()]
    assert got == list(golden.values())


def test_landed_feeds_keep_their_feed_and_place(spark):
    d = _tmp()
    docs = {
        (0, "a.xml"): RSS,
        (0, "b.xml"): "<channel><item><title>bad & worse</title><link>x</link></item><item><title>after</title><link>https://a.org/9</link></item></channel>",
        (1, "a.xml"): ATOM,
        (7, "a.xml"): "<feed></feed>",
    }
    for (feed, name), text in docs.items():
        os.makedirs(os.path.join(d, f"feed_id={feed}"), exist_ok=True)
        with open(os.path.join(d, f"feed_id={feed}", name), "w") as f:
            f.write(text)
    cfg = os.path.join(_tmp(), "feeds.json")
    with open(cfg, "w") as f:
        json.dump({"feeds": [{"name": "N", "url": "u", "tags": ["ai"], "weight": 0.9}, {"name": "N", "url": "v", "tags": ["ops"], "weight": 0.2}]}, f)
    good, bad = FS.quarantine(FS.read_landed_feeds(spark, d))
    rows = {(r.feed_id, r.entry_no): r for r in D.enrich_landed(good, FS.read_feed_config(spark, cfg)).collect()}
    assert {k: (r.kind, r.link) for k, r in rows.items()} == {
        (0, 1): ("rss", "https://a.org/1?utm_source=x"), (0, 2): ("rss", None), (0, 3): ("rss", "https://a.org/3"), (0, 6): ("rss", "https://a.org/9"),
        (1, 1): ("atom", "https://b.org/e1"), (1, 2): ("atom", "https://b.org/e2"),
    }
    assert {(k[0], r.source, tuple(r.feed_tags), r.feed_weight) for k, r in rows.items()} == {(0, "N", ("ai",), 0.9), (1, "N", ("ops",), 0.2)}
    assert sorted(rows, key=lambda k: rows[k].pos) == sorted(rows)
    assert [(r.feed_id, os.path.basename(r.file), r.first_entry_no, r.n_rows) for r in bad.collect()] == [(0, "b.xml", 4, 2)]


def test_landed_feeds_of_an_empty_folder(spark):
    good, bad = FS.quarantine(FS.read_landed_feeds(spark, _tmp()))
    assert good.count() == 0 and bad.count() == 0 and "entry_no" in good.columns
