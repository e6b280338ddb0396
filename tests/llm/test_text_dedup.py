"""Line dedup, near-duplicate join and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import jaccard_join as J
from gleaner.llm.components import components
from gleaner.llm.line_dedup import dedup_lines, line_dedup_report
from gleaner.llm.mph import PerfectHash
from tests.conftest import SF0001

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    """(doc_id, text) rows -> kept lines of each row."""
    holders = defaultdict(set)
    keyed = []
    for d, text in rows:
        lines = [(x, x.strip(BLANKS).translate(ASCII_LOWER)) for x in (text or "").split("\n")]
        keyed.append((d, lines))
        for _, k in lines:
            if len(k) >= 10:
                holders[k].add(-(1 << 70) if d is None else d)
    out = []
    for d, lines in keyed:
        own = -(1 << 70) if d is None else d
        out.append((d, len(lines), [x for x, k in lines if not (len(holders.get(k, ())) > 1 and min(holders[k]) != own)]))
    return out


@pytest.mark.parametrize("which", ["edge", "table"])
def test_line_dedup_equals_brute_force(spark, edge_docs, which):
    docs = edge_docs if which == "edge" else spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((repr(d), n, n - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for d, n, k in brute_lines(rows))
    got = sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup_report(docs).collect())
    assert got == want
    texts = sorted(repr(("\n".join(k))) for _, _, k in brute_lines(rows))
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(repr(r.text or "") for r in out.collect()) == texts


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup_report(no_docs).count() == 0 and dedup_lines(no_docs).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 2**32))
def test_perfect_hash_is_minimal_and_tells_foreign_keys(pairs, seed):
    keys = np.array([k for k, _ in pairs], np.uint64)
    prints = np.array([p for _, p in pairs], np.uint64)
    h = PerfectHash(keys, prints)
    assert sorted(h.find(keys, prints).tolist()) == list(range(len(pairs)))
    values = np.arange(len(pairs))
    assert (h.arrange(keys, prints, values)[h.find(keys, prints)] == values).all()
    foreign = np.random.default_rng(seed).integers(0, 2**63, (50, 2)).astype(np.uint64)
    assert (h.find(foreign[:, 0], foreign[:, 1] + np.uint64(1 << 63)) == -1).all() or pairs & set(map(tuple, foreign.tolist()))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=75):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d, _ in sets}, [len(s) for _, s in sets]


def near_copies(seed, n_groups=6, size=14):
    """Groups whose members drift: chains of links, members near and below the threshold."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    passage = [rng.choice(vocab) for _ in range(60)]
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(6, 150))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((i, " ".join(text)))
            i += 1
    for _ in range(20):
        own = [rng.choice(vocab) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(passage + own)))
        i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "a b"), (i + 4, "A  b")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_equals_brute_force(spark, tmp_path, seed):
    rows = near_copies(seed)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    want, sizes = brute_components(rows)
    got = J.similar_components(spark.read.parquet(path), rounds=seed % 3).collect()
    assert {r.doc: r.component for r in got} == want
    assert {r.doc: r.n_shingles for r in got} == {d: n for (d, _), n in zip(rows, sizes)}


def test_jaccard_join_edge_rows_and_kept_documents(spark, edge_docs, no_docs):
    got = J.similar_components(edge_docs).collect()
    assert len(got) == edge_docs.count()
    comp = {r.doc: r.component for r in got}
    assert comp[5] == comp[6] == 5 and comp[7] == comp[4] == 4
    assert comp[1] == 1 and comp[2] == 2 and comp[3] == 3
    assert comp[J.NULL_ID] == J.NULL_ID
    kept = J.keep_one_per_component(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {None if d == J.NULL_ID else d for d, c in comp.items() if d == c}
    assert J.similar_components(no_docs).count() == 0 and J.keep_one_per_component(no_docs).count() == 0


def test_rows_that_repeat_an_id_are_one_node(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    a, b = "a b c d e f g", "q r s t u v w"
    spark.createDataFrame([(5, a), (5, b), (2, a), (9, b), (11, "z z z z z z")], "doc_id long, text string").write.parquet(path)
    got = {(r.doc, r.component) for r in J.similar_components(spark.read.parquet(path)).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (11, 11)}


def test_adaptive_prefix_asks_for_matches_on_frequent_tokens():
    """Rare tokens ask for the floor of the set's size (1 below 20 shingles), frequent ones for more."""
    counts, frequent = np.zeros(J.CountSketch.size), np.full(J.CountSketch.size, 1000.0)
    for n in (9, 19, 60, 200):
        tokens = np.sort(J.mixed(np.arange(n, dtype=np.uint64), 9))
        prefix, least = J.prefix_of(tokens, counts, 0.0, 75)
        assert least == J.fewest_matches(n) and len(prefix) == n - J.least_overlap(n, 75) + least
        prefix, matches = J.prefix_of(tokens, frequent, 0.0, 75)
        assert matches > least and len(prefix) == n - J.least_overlap(n, 75) + matches
    assert [J.fewest_matches(n) for n in (1, 19, 200)] == [1, 1, 8]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab C\n\té", max_size=30) | st.none(), max_size=6))
def test_shingle_sets_count_like_python(texts):
    assert [len(s) for s in J.shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_hashing_keeps_little_memory_and_does_not_depend_on_the_chunk(monkeypatch):
    """A worker lives through many tasks: what it keeps must not follow the texts that it has met."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Ab", "cé", "d\tE", "fgh"]) + str(rng.randint(0, 300)) for _ in range(n)) for n in (0, 3, 40, 900, 5, 200_000, 60, 7)] + [None, " "]
    sets = J.shingle_sets(texts * 3)
    assert J._POWERS.up.nbytes + J._POWERS.down.nbytes < 10e6
    for size in (64, 1 << 22):
        monkeypatch.setattr(J, "_CHUNK", size)
        monkeypatch.setattr(J, "_POWERS", J._Powers())
        assert all(np.array_equal(x, y) for x, y in zip(sets, J.shingle_sets(texts * 3), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=300), st.sets(st.integers(0, 400), max_size=300))
def test_parity_bits_differ_at_most_where_sets_do(a, b):
    bits = [J.parity_bits(J.mixed(np.array(sorted(x), np.uint64), 5)).view(np.uint64) for x in (a, b)]
    differ = sum(int(x).bit_count() for x in bits[0] ^ bits[1])
    assert differ <= len(a ^ b) and (differ - len(a ^ b)) % 2 == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(1, 2), (2, 3), (3, 1)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 1: 1, 2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _batches(rows, names, size):
    import pyarrow as pa

    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(len(names))], names=names)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_token_numbers_are_exact_and_frequent_lists_pass_on(monkeypatch, size):
    monkeypatch.setattr(J, "FREQUENT", 5)
    lengths = {1: 1, 2: 2, 3: 4, 4: 12, 5: 1, 6: 5, 7: 3}
    rows = [(t, n) for t, k in lengths.items() for n in range(k)]
    got = [tuple(r.values()) for b in J._counted(_batches(rows, ["token", "node"], size)) for r in b.to_pylist()]
    assert got == [(t, n, min(lengths[t], 5)) for t, n in rows if lengths[t] > 1]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_sets_are_gathered_over_batches(size):
    rows = [(10 * n + i, n) for n, k in ((1, 1), (2, 5), (3, 2)) for i in range(k)]
    got = {r["node"]: np.frombuffer(r["tokens"], np.int64).tolist() for b in J._gathered(_batches(rows, ["token", "node"], size)) for r in b.to_pylist()}
    assert got == {n: [t for t, m in rows if m == n] for n in (1, 2, 3)}


def test_near_copies_leave_the_last_join_once():
    """Two sets that share most tokens meet in many lists; only the first one has no shared token before it."""
    import pyarrow as pa

    shared = np.arange(1000, 1200)
    sets = [np.sort(np.concatenate([shared[np.arange(200) % 9 != k], 2000 + 100 * k + np.arange(10)])) for k in (1, 2)]
    table = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([len(x) + 3 for x in sets]), pa.array([x.tobytes() for x in sets])], names=["node", "n", "tokens"])
    rows = [r for b in J._prefixes(75, J.WINDOW)([table]) for r in b.to_pylist()]
    of = [{r["token"]: r for r in rows if r["node"] == n} for n in (1, 2)]
    both = of[0].keys() & of[1].keys()
    met = [t for t in both if not set(of[0][t]["before"]) & set(of[1][t]["before"])]
    assert len(both) > 20 and met == [min(both)]
    assert of[0][min(both)]["pos"] == 3 + 1 + int(np.searchsorted(sets[0], min(both)))
    assert all(len(of[n]) == len(x) - J.least_overlap(len(x) + 3, 75) + 1 for n, x in enumerate(sets))


def test_only_shared_tokens_travel(spark):
    """Own tokens are counted but left out; sets with too many of them are gone."""
    sets = {1: range(0, 20), 2: range(1, 21), 3: range(10, 30)}
    rows = [(n, len(x), bytearray(np.array(x, np.uint64).tobytes())) for n, x in sets.items()]
    got = {r.node: (r.own, np.frombuffer(r.tokens, np.int64).tolist()) for r in J._shared_sets(spark.createDataFrame(rows, "node long, n long, tokens binary"), 75).collect()}
    rare_first = lambda x: sorted(x, key=lambda t: (sum(t in s for s in sets.values()), t))
    assert got == {1: (1, rare_first(range(1, 20))), 2: (0, rare_first(range(1, 21)))}
