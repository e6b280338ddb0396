"""Mixing: targets, balance and bounds. Sharding: one law, gapless slots, stable growth."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleaner.llm.mixing import WEIGHTS, balanced_rates, mix_documents, mix_stage
from gleaner.llm.sharding import Leaf, regular_topology, shard_documents, shard_of
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by plain bisection on the common level."""
    total = share * sum(sizes.values())
    lo, hi = 0.0, total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * sizes[s], weights[s] * mid) for s in sizes) < total else (lo, mid)
    return {s: min(cap * sizes[s], weights[s] * hi) for s in sizes}


def expected(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    return sizes, water_filled(sizes, weights, 1.5, 2)


def check_mix(docs, tolerance):
    sizes, targets = expected(docs.collect())
    got = mix_documents(docs, WEIGHTS).join(docs.withColumn("_k", F.monotonically_increasing_id()).select("_k", "source"), F.col("_row") == F.col("_k"))
    rows = got.collect()
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        assert r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) <= 1e-6 * max(1, targets[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(tolerance * target, 1 + largest[s] / 2), s
    return rows


def test_mix_meets_targets_on_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = check_mix(docs, 0.01)
    assert len(rows) == docs.count()
    again = {r.doc_id: r.taken for r in mix_documents(docs, WEIGHTS).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_edge_rows(edge_docs, no_docs):
    rows = check_mix(edge_docs, 0.02)
    assert len(rows) == edge_docs.count()
    assert {r.doc_id: r.taken for r in rows}[2] == 0
    assert mix_documents(no_docs, WEIGHTS).count() == 0


def test_mix_stage_repeats_rows(edge_docs, no_docs):
    copies = Counter()
    for r in mix_documents(edge_docs, WEIGHTS).collect():
        copies[r.doc_id] += r.copies
    out = mix_stage(edge_docs, WEIGHTS)
    assert out.columns == edge_docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mix_stage(no_docs, WEIGHTS).count() == 0


def test_newton_tilts_priors_under_the_cap(spark):
    cells = spark.createDataFrame([("a", 1.0, 100), ("a", 0.5, 300), ("b", 1.0, 10), ("c", 2.0, 50)], "source string, prior double, words long")
    targets = spark.createDataFrame([("a", 400.0), ("b", 20.0), ("c", 1.0)], "source string, target double")
    rates = {(r.source, r.prior): r.rate for r in balanced_rates(cells, targets, 2.0).collect()}
    assert abs(100 * rates["a", 1.0] + 300 * rates["a", 0.5] - 400) < 1e-6
    # tilted exponentially: the same multiplier, up to the cap
    assert abs(rates["a", 1.0] / rates["a", 0.5] - 2.0) < 1e-6
    assert abs(rates["b", 1.0] - 2.0) < 1e-6 and abs(50 * rates["c", 2.0] - 1.0) < 1e-9


EIGHT = regular_topology(8)


def test_shards_follow_the_key_law(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    grown = [*EIGHT, Leaf("region2", "rack0", 8)]
    for table in (docs, edge_docs):
        rows = shard_documents(table, EIGHT, grown).collect()
        assert len(rows) == table.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_id = defaultdict(set)
        for r in rows:
            by_id[r.doc_id].add(r.shard)
        assert all(len(s) == 1 for s in by_id.values())
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in shard_documents(edge_docs, EIGHT, grown).collect()}
    assert sizes[1] == (1, 0) and sizes[2] == (1, 0) and sizes[4][0] == 8
    assert shard_documents(no_docs, EIGHT, grown).count() == 0


def test_weights_move_rows_only_in_their_subtree(spark):
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in EIGHT]
    ids = spark.range(20_000).select("id", shard_of(F.col("id"), EIGHT).alias("a"), shard_of(F.col("id"), heavier).alias("b"))
    moved = ids.where("a <> b").collect()
    assert moved and all(r.b // 4 == 1 for r in moved)  # into the region of shard 5
    inside = [r for r in moved if r.a // 4 == 1 and r.a // 2 != 2]
    assert all(r.b in (4, 5) for r in inside)  # and within it into its rack
    share = ids.where("b = 5").count() / 20_000
    assert abs(share - 0.3) < 0.02
    light = [x._replace(weight=0.0) if x.shard == 1 else x for x in EIGHT]
    assert spark.range(5000).where(shard_of(F.col("id"), light) == 1).count() == 0
