"""Neighbours, packing, fingerprints, toxicity, url filters and licences on fixtures and the small tables."""

from __future__ import annotations

import ctypes
import hashlib
import math
import resource
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import fingerprints as P
from gleaner.llm import common, licences, line_dedup, toxicity, url_filters
from gleaner.llm.neighbours import nearest, perturbations
from gleaner.llm.packing import SumOfSquaresPacker, WordTokenizer, pack_documents, tokenizer_file
from gleaner.llm.toxicity import FOLD, N, Decoder, character_model, features, held_out, reject_toxic, toxicity_scores
from tests.conftest import SF001, SF0001

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same_as_sql(df, sql, views):
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in res.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("module, query", [(line_dedup, "q_line_dedup"), (licences, "q_licences"), (url_filters, "q_url_filters")])
def test_sql_twins(spark, module, query):
    same_as_sql(getattr(module, query)(spark, SF0001), module.SQL, {t: f"{SF0001}/{t}.parquet" for t in TABLES})


# neighbours -----------------------------------------------------------------


def test_perturbations_come_in_order_of_cost():
    f = np.array([0.1, 0.5, 0.8])
    got = perturbations(f, 27)
    assert got[0] == () and got[1] == ((0, -1),) and len(set(got)) == 27

    def cost(s):
        return sum((f[j] if d < 0 else 1 - f[j]) ** 2 for j, d in s)

    costs = [cost(s) for s in got]
    assert costs == sorted(costs)


def brute_nearest(rows, is_query, k):
    valid = {}
    for i, v in rows:
        if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid[i] = np.array(v, float)
    out = {}
    for q, x in valid.items():
        if is_query(q):
            near = [(-round(float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), 10), i) for i, y in valid.items() if i != q]
            out[q] = [i for _, i in sorted(near)[:k]]
    return out


def test_neighbours_with_copies_ties_and_invalid_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(1, 120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 215)]  # more copies than k
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [math.nan, 1.0, 1.0, 1.0]), (304, [math.inf, 1.0, 0.0, 0.0]), (305, [1.0, 1.0]), (None, [1.0] * 4), (1, rows[0][1])]
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    got = defaultdict(dict)
    for r in nearest(table, F.col("vec_id") % 5 == 0, 5, recall=1.0).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    want = brute_nearest(rows, lambda q: q % 5 == 0, 5)
    assert set(got) == set(want)
    hits = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert list(got[200].values()) == want[200] == [201, 202, 203, 204, 205]
    assert nearest(table.where("vec_id in (1, 300)"), F.col("vec_id") == 1).count() == 0
    assert nearest(table.where("false"), F.col("vec_id") == 1).count() == 0


def test_neighbour_recall_on_the_table(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = defaultdict(set)
    for r in nearest(e, F.col("vec_id") % 50 == 0).collect():
        a, b = rows[r.query_id], rows[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(found[q] & set(ids[np.argsort(-s)[:5]]))
        total += 5
    assert hits >= 0.9 * total


# packing --------------------------------------------------------------------


def check_pieces(pieces, sizes, window):
    """Every token of every document in one piece; sequences gapless and within the window."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        by_doc[doc].append((start, n))
        by_seq[seq].append((offset, n))
    for doc, n in sizes.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(2, 12))
def test_packer_loses_nothing_and_pads_once_per_settlement(sizes, max_open):
    packer = SumOfSquaresPacker(window=32, max_open=max_open)
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n, dtype=np.uint32))
    packer.settle()
    for doc, start, ids, total, _, _ in packer.done:
        assert ids.tolist() == list(range(start, start + len(ids))) and total == sizes[doc]
    padding = check_pieces([(d, s, len(i), q, o) for d, s, i, _, q, o in packer.done], dict(enumerate(sizes)), 32)
    assert padding < 32


def test_packer_takes_the_level_with_the_smallest_sum_of_squares():
    packer = SumOfSquaresPacker(window=10)
    sizes = [3, 4, 6, 2, 2, 5, 7]
    counts = np.zeros(11, int)
    for d, n in enumerate(sizes):
        options = []
        for h in [0, *np.flatnonzero(counts)]:
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + n <= 10:
                if h + n < 10:
                    after[h + n] += 1
                options.append((after**2).sum())
        packer.add(d, np.zeros(n, np.uint32))
        counts = packer.counts.copy()
        assert (counts**2).sum() == min(options)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abDÉéßΣσİ019.,'&-_ \t\n\x1ć\xa0 ²Ⅷ<|>endoftext", max_size=40), min_size=1, max_size=4))
def test_word_tokenizer_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    own = WordTokenizer(tokenizer_file())
    plain = Tokenizer.from_file(tokenizer_file())
    assert own.ids([*texts, *texts]) == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, *texts]]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_packing_covers_all_documents(spark, edge_docs, no_docs, tokenizer, which):
    docs = (edge_docs if which == "edge" else spark.read.parquet(f"{SF0001}/documents.parquet")).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = pack_documents(docs, tokenizer_file()).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], {d: len(i) for d, i in ids.items()}, 4096)
    assert pack_documents(no_docs, tokenizer_file()).count() == 0


# fingerprints ---------------------------------------------------------------


def test_fingerprints_and_edits(edge_docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = P.fingerprint_documents(edge_docs).collect()
    assert len(got) == len(rows)
    edits = defaultdict(list)
    for i, (d, text) in enumerate(order):
        k = len(text) // 4
        edited = text[: len(text) - k] + order[(i + 1) % len(order)][1][:k]
        edits[d].append((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in edits[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[5] == prints[6] and prints[4] == prints[7] and prints[1] == prints[2] and prints[9] != prints[10]
    long = next(r for r in got if r.doc_id == 5)
    assert long.near_next == 1.0 and 0.7 < long.near_edited < 0.9  # the next text is its copy
    assert P.fingerprint_documents(no_docs).count() == 0


def test_one_document_is_its_own_next(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string").write.parquet(path)
    (r,) = P.fingerprint_documents(spark.read.parquet(path)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_differing_branches_locate_the_edit(spark):
    paragraphs = [f"Paragraph number {i} has its own words. And a second sentence {i * i}." for i in range(60)]
    edited = [*paragraphs[:30], "Something new.", *paragraphs[30:40], "Changed.", *paragraphs[41:]]
    df = spark.createDataFrame([("\n".join(paragraphs), "\n".join(edited))], "a string, b string")
    f = df.select(P.fingerprint(F.col("a")).alias("a"), P.fingerprint(F.col("b")).alias("b"))
    (r,) = f.select(P.changed_paragraphs(F.col("a"), F.col("b")).alias("gone"), P.changed_paragraphs(F.col("b"), F.col("a")).alias("new"), "a", "b").collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    assert r.gone == [md5(paragraphs[40])]
    assert r.new == [md5("Something new."), md5("Changed.")]
    shared = set(r.a.split("|")[1].split(";")) & set(r.b.split("|")[1].split(";"))
    assert shared  # untouched sections keep their whole branch


# toxicity -------------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder(spark):
    model = character_model(spark.read.parquet(f"{SF001}/documents.parquet"))
    assert model.shape == (N, N, N) and np.isfinite(model).all()
    return Decoder(model)


@pytest.mark.parametrize("seen, word", [
    ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("cl0wn!!!", "clown"), ("sc_um", "scum"),
    ("path3t1c", "pathetic"), ("plain", "plain"), ("Élan".lower(), "elan"), ("don't", "dont"), ("12345", ""), ("...", ""), ("", ""),
])
def test_decoder_restores_disguised_words(decoder, seen, word):
    assert features("", decoder.read(seen)[1]) == features("", word)


def test_letters_set_apart_are_joined(decoder):
    _, apart = decoder.words("you are an i d i o t, he said")
    assert "idiot" in apart
    assert decoder.words(None) == (set(), [])


def test_viterbi_finds_the_best_path(decoder):
    """Against full enumeration on short lattices without repeats or noise."""
    for word in ("1n", "0ld", "8ig", "5ee1"):
        options = [""]
        for o in word:
            options = [p + "abcdefghijklmnopqrstuvwxyz"[c - 1] for p in options for c, _ in decoder.readings[o]]

        def score(s):
            total, a, b = 0.0, 0, 0
            for o, ch in zip(word, s):
                c = ord(ch) - 96
                total += dict(decoder.readings[o])[c] + decoder.lm[a][b][c]
                a, b = b, c
            return total + decoder.lm[a][b][0]

        best = max(options, key=score)
        assert decoder.viterbi(word) == best or len(decoder.viterbi(word)) < len(word)


def test_held_out_quality_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    tp = ((x.predicted == 1) & (x.toxic == 1)).sum()
    assert tp / (x.toxic == 1).sum() > 0.8 and tp / (x.predicted == 1).sum() > 0.75
    assert ((x.predicted == 1) == (x.score >= 0.3)).all()


def test_toxicity_edge_rows(spark, edge_docs, no_docs):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity_scores(edge_docs, nothing).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score < 0.3 and r.predicted == 0 for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[1] == (zlib.crc32(b"1") % 4 == 2)
    labels = spark.createDataFrame([(20, 1, 1), (20, 1, 0), (21, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity_scores(edge_docs, labels).count() == edge_docs.count()
    assert toxicity_scores(no_docs, labels).count() == 0
    kept = reject_toxic(edge_docs, nothing)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_planted_disguises_are_caught(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    planted = spark.createDataFrame([(10_001, "the and m0r0n of thing"), (10_002, "erer the i d i o t of"), (10_003, "the w o r d s of thing"), (10_004, "stuuuupid the of")], "doc_id long, text string")
    scores = {r.doc_id: r.predicted for r in toxicity_scores(docs.select("doc_id", "text").unionByName(planted), labels).where("doc_id > 10000").collect()}
    assert scores == {10_001: 1, 10_002: 1, 10_003: 0, 10_004: 1}


def test_counting_gives_back_what_earlier_stages_left_in_the_worker():
    """A pipeline's workers come from packing with its tokenizer and the words it knows."""
    model = np.log(np.full((N, N, N), 1 / N))
    batch = pa.RecordBatch.from_pydict({"text": ["a fine day", None], "toxic": [0, 1]})
    for run in (toxicity._trigrams, toxicity._feature_counts(model)):
        common.worker_keeps("words of a file", dict)
        assert sum(b.num_rows for b in run(iter([batch]))) > 0 and not common._kept


def test_a_worker_gives_freed_memory_back_to_the_machine():
    """Freed blocks below one that is held stay with the process unless it asks for a trim."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is None:
        pytest.skip("needs glibc")

    def mb():
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6

    trim(0)
    start, blocks = mb(), [bytes(5000) for _ in range(30_000)]
    held = blocks[::1000]
    full = mb()
    del blocks
    common.worker_lets_go()
    assert full - start > 100 and mb() - start < 30 and len(held) == 30


def test_feature_counts_passed_on_in_parts_add_up(monkeypatch):
    monkeypatch.setattr(toxicity, "_COUNTED", 40)
    monkeypatch.setattr(toxicity, "_LISTS_CACHE", 5)
    model = np.log(np.full((N, N, N), 1 / N))
    texts = [f"{a}stone {b}wick{a} shared word" for a in ("amber", "birch", "cedar", "doler") for b in ("fenn", "gorse", "hazel", "iriss")] * 20 + [None, ""]
    rows = [(t, i % 3 == 0) for i, t in enumerate(texts)]
    decoder, want = Decoder(model), Counter()
    for t, toxic in rows:
        for f in {""}.union(*(features(*decoder.read(w)) for w in (t or "").split())):
            want[f, toxic] += 1
    got, sizes = Counter(), []
    batches = [pa.RecordBatch.from_pydict(dict(zip(("text", "toxic"), map(list, zip(*rows[i : i + 300]))))) for i in (0, 300)]
    for b in toxicity._feature_counts(model)(iter(batches)):
        sizes.append(b.num_rows)
        for r in b.to_pylist():
            got[r["f"], False] += r["clean"]
            got[r["f"], True] += r["toxic"]
    assert +got == want and len(sizes) > 4 and max(sizes) <= 60


def test_folding_keeps_letters():
    assert "éàñüß".translate(FOLD) == "eanuss"


def test_held_out_of_null(spark):
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first().h is False


# url filters ----------------------------------------------------------------


def test_captures_meet_entries_active_at_their_time(spark):
    events = spark.createDataFrame(
        [("domain:bad.org", "l1", 10, True), ("domain:bad.org", "l1", 20, False), ("domain:bad.org", "l1", 30, True), ("domain:bad.org", "l1", 30, True),
         ("host:a.b.org", "l2", 5, True), ("prefix:a.b.org/x/", "l3", 0, True), ("prefix:a.b.org/x/", "l3", 7, True), ("prefix:a.b.org/x/", "l3", 9, False),
         ("host:z.org", "l2", 4, True), ("host:z.org", "l2", 4, False), (None, "l2", 4, True), ("host:n.org", "l2", None, True)],
        "entry string, list string, at int, active boolean",
    )
    urls = [
        (1, "http://www.bad.org/p", 9), (2, "http://www.bad.org/p", 10), (3, "https://bad.org", 20), (4, "http://u@x.BAD.org:80/?q", 31), (5, "http://notbad.org/", 31),
        (6, "http://a.b.org/x/y", 8), (7, "http://a.b.org/x/y", 9), (8, "http://a.b.org/xy", 4), (9, "http://z.org/", 5), (10, None, 5), (11, "not a url", 5), (12, "http://bad.org/", None), (1, "http://www.bad.org/p", 9),
    ]
    captures = spark.createDataFrame([(*u, "clash") for u in urls], "id int, url string, fetched_at int, entry string")
    got = [(r.id, r.n_active, r.blocked_by) for r in url_filters.filter_captures(captures, events).orderBy("id").collect()]
    assert got == [
        (1, 0, None), (1, 0, None), (2, 1, "l1"), (3, 0, None), (4, 1, "l1"), (5, 0, None), (6, 2, "l2,l3"), (7, 1, "l2"), (8, 0, None), (9, 0, None), (10, 0, None), (11, 0, None), (12, 0, None),
    ]
    assert url_filters.filter_captures(captures, events.where("false")).where("n_active > 0").count() == 0
    assert url_filters.filter_captures(captures.where("false"), events).count() == 0


# licences -------------------------------------------------------------------


def test_licences_match_whole_texts_in_any_spelling(spark, tmp_path):
    mit = dict((n, t) for n, t in licences.KNOWN[:1])["MIT"]
    variants = mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,").replace("MERCHANTABILITY", "merchantibility")
    rows = [
        (1, "Copyright (c) 2024 A. Person\n\n" + variants), (2, mit + "\nextra words"), (3, "some text\nRELEASED under the MIT licence!\nmore"),
        (4, None), (5, ""), (6, " \n-- \n"), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."),
    ]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").write.parquet(path)
    known = licences.known_digests(spark)
    got = {r.doc_id: r for r in licences.scan_licences(spark.read.parquet(path), known).collect()}
    assert got[1].licence == "MIT" and got[2].licence is None
    assert got[3].licence is None and (got[3].n_notices, got[3].notices, got[3].n_lines) == (1, "MIT", 3)
    assert got[4].digest is None and got[5].n_lines == 0 and got[6].licence is None
    assert got[7].licence == "CC-BY-NC-4.0" and got[7].n_notices == 1
    assert licences.scan_licences(spark.read.parquet(path), known).count() == len(rows)
    assert licences.scan_licences(spark.read.parquet(path).where("false"), known).count() == 0


def test_words_of_ascii_only_need_no_pattern(monkeypatch):
    """Signs after ASCII letters are parted without the letter patterns, a text at a time, with the same ids."""
    from gleaner.llm import packing

    class Refuses:
        def fullmatch(self, _):
            raise AssertionError("a pattern was asked about a word of ASCII only")

        search = fullmatch

    text = "Plain words, 'quoted' don't (stop) a1 x--; !!! end...) MIXED'S CASE?! Plain words,"
    own = WordTokenizer(tokenizer_file())
    expected = own.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "_TAIL", Refuses())
    monkeypatch.setattr(packing, "_CONTEXT", Refuses())
    assert own.ids([text, None, text, "Plain"]) == [expected, [], expected, own.tokenizer.encode("Plain", add_special_tokens=False).ids]
