"""Results do not depend on how a later scan cuts the files into splits."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import fingerprints as P
from gleaner.llm import mixing as M
from gleaner.llm.common import file_row


@pytest.fixture()
def stored(spark, tmp_path):
    """Four files; some ids are null or repeated, with different texts."""
    rows = [(None if i % 9 == 0 else i // 2, f"text {i} " + "word " * (i % 7) + f"end {i}.\nsecond line {i}", "s%d" % (i % 3)) for i in range(200)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def other_splits(spark, monkeypatch):
    """After the first checkpoint of an operator, files are cut into one more split each."""
    conf = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {c: spark.conf.get(c) for c in conf}

    def use(module):
        plain = module.cut

        def cut(df):
            out = plain(df)
            for c in conf:
                spark.conf.set(c, "1500")
            return out

        monkeypatch.setattr(module, "cut", cut)

    yield use
    for c, v in before.items():
        spark.conf.set(c, v)


def test_keys_are_unique_and_the_same_in_every_scan(spark, stored, other_splits):
    keys = lambda: {(r.k.file, r.k.row): r.text for r in stored.select(file_row().alias("k"), "text").collect()}
    first = keys()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    assert len(first) == 200 and keys() == first


def test_fingerprints_survive_other_splits(stored, other_splits):
    want = sorted(map(repr, P.fingerprint_documents(stored).collect()))
    other_splits(P)
    assert sorted(map(repr, P.fingerprint_documents(stored).collect())) == want and len(want) == 200


def test_mixed_rows_survive_other_splits(stored, other_splits):
    chosen = M.mix_documents(stored, M.WEIGHTS, key=file_row()).select("_row", "copies").collect()
    texts = {r.k: r.text for r in stored.select(file_row().alias("k"), "text").collect()}
    want = Counter({texts[r["_row"]]: r.copies for r in chosen if r.copies})
    other_splits(M)
    out = M.mix_stage(stored, M.WEIGHTS)
    assert out.columns == stored.columns
    assert Counter(r.text for r in out.select(F.col("text")).collect()) == want
