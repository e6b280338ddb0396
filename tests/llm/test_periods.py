"""Runs from stitched tiles against a brute-force search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from gleaner.llm import periods as X
from gleaner.llm.common import importable


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, period, length), from all maximal stretches of all periods."""
    n, runs = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            smaller = (p for p in range(1, q) if q % p == 0 and all(w[t] == w[t + p] for t in range(i, i + size - p)))
            if size >= max(12, 2 * q) and next(smaller, None) is None:
                runs.append((i, q, size))
            i = j
    return sorted(runs)


def brute_words(doc_id, w: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_report(rows) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        w = brute_words(doc_id, (text or "").encode().split())
        runs = brute_runs(w)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, q, n in runs)]
        best = (None,) * 4
        if runs:
            s, q, n = sorted(runs, key=lambda r: (-r[2], r[0], r[1]))[0]
            best = (s, n, q, 1000 * n // q)
        listing = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        out.append((doc_id, len(runs), *best, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def reported(df) -> list[tuple]:
    return sorted((tuple(r) for r in X.report(X.documents_with_runs(df, X.periodic_words)).collect()), key=repr)


def repeating_texts(seed: int, n: int) -> list:
    rng = random.Random(seed)
    texts: list = [None, "", " \t", "a " * 300, "a b " * 70, "x y z " * 4, "x y z " * 3 + "x y"]
    for _ in range(n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randrange(4)):
            q, i = rng.randint(1, 50), rng.randrange(len(w))
            block = w[i : i + q]
            w[i:i] = (block * rng.randint(2, 9))[: rng.randint(len(block), 9 * len(block))]
        texts.append(rng.choice([" ", "\n", "\x0b "]).join(w))
    return texts


def test_runs_equal_brute_force(spark):
    importable(spark)
    rows = [(None if i % 17 == 16 else i % 400, t) for i, t in enumerate(repeating_texts(4, 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert reported(df) == brute_report(rows)


def test_long_stretches_are_stitched_from_many_tiles(spark):
    importable(spark)
    rng = random.Random(2)
    block = [str(rng.random()) for _ in range(37)]
    words = [*(str(rng.random()) for _ in range(501)), *(block * 60)[:2100], *(str(rng.random()) for _ in range(77))]
    df = spark.createDataFrame([(-7, " ".join(words))], "doc_id long, text string")
    tiles = X.tile_documents(df).where(F.col("octave").isNotNull())
    assert tiles.count() > 4 and X.solve_tiles(tiles).count() > 20
    found = X.documents_with_runs(df).collect()[0]
    assert [tuple(r) for r in found.runs] == [(501, 37, 2100)]


def test_registered_query_on_whole_texts(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect() if len(r.text or "") < 5000]
    got = reported(edge_docs)
    assert len(got) == edge_docs.count()
    short = set(brute_report(rows))
    assert short <= set(got)
    # 30,000 random words have no run but the planted one
    for r in got:
        if r not in short:
            h = zlib.crc32(str(r[0]).encode())
            a = h // 10 % 30_000
            planted = (1, a, 30_000 - a, 1 + (30_000 - a) // (3 + h // 10 % 8))
            assert r[1:5] == (planted if h % 10 == 0 else (0, None, None, None))
    assert reported(no_docs) == []


def test_z_function():
    assert X.z_function([1, 1, 2, 1, 1, 2, 1]) == [7, 1, 0, 4, 1, 0, 1]
    assert X.z_function([]) == []
