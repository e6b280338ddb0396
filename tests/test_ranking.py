"""row_number_within: exact numbering with null and hot groups."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner.operators import report as R
from gleaner.operators.ranking import row_number_within


def test_row_number_within_matches_model(spark):
    rng = random.Random(7)
    groups = [None, "hot", "a", "b"]
    rows = [(rng.choice(groups) if i % 3 else "hot", rng.randint(0, 50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, score int, pos long")
    got = {r["pos"]: r["rn"] for r in row_number_within(df, ["g"], [F.col("score").desc(), F.col("pos")], "rn").collect()}
    exp = {}
    for g in groups:
        sub = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))
        exp.update({r[2]: i + 1 for i, r in enumerate(sub)})
    assert got == exp


def test_row_number_within_no_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = [r["rn"] for r in row_number_within(df, [], [F.col("k")], "rn").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_sections_numbered_on_keys_equal_sections_of_the_ranking(spark):
    rows = [("t", 1, "read", 90, 5), ("t", 2, "ignore", 99, 1), ("t", 3, "read", 90, 5), ("t", 4, None, 10, 10), ("t", 5, "odd", 50, 0),
            ("t", 6, "ignore", 20, 1), ("u", 7, "ignore", 1, 1), (None, 8, "skim", 3, 3), (None, 9, "ignore", 3, 3)]
    schema = "topic string, pos long, rec string, signal int, fluff int"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "topic", "pos", "named_struct('recommendation', rec, 'signal_score', signal, 'fluff_score', fluff) as analysis")
    place = lambda d: sorted((r.pos, r.section, r.section_rank) for r in d.collect())
    assert place(R.sectioned(df)) == place(R.with_sections(R.digest_rank(df)))
    assert R.sectioned(df.limit(0)).count() == 0
    again = R.sectioned(df.unionByName(df)).collect()
    assert len(again) == 18 and sorted(r.section_rank for r in again if r.topic == "t" and r.section == "kept") == list(range(1, 7))
