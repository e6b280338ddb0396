"""Near duplicates where doc_ids are null or repeated, with equal and with different texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from gleaner.llm import jaccard_join as J
from tests.llm.conftest import words


def near(text: str) -> str:
    return text + " tail"


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    rng = random.Random(8)
    t = [words(rng, 60) for _ in range(9)]
    rows = [
        (None, t[0]), (10, t[0]),                      # a null id equal to a document
        (None, t[1]), (11, near(t[1])),                # another null id, similar to another document
        (None, t[2]), (None, near(t[2])),              # similar texts without ids
        (None, t[3]), (None, t[3]), (None, t[4]),      # equal and lone texts without ids
        (3, t[5]), (3, t[6]), (20, near(t[5])), (21, near(t[6])),  # one id, two texts, a partner for each
        (3, t[7]), (22, t[8]), (None, None), (None, " "), (3, ""),
    ]
    path = str(tmp_path_factory.mktemp("ids") / "documents.parquet")
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, nr int").repartition(3).write.parquet(path)
    return t, rows, spark.read.parquet(path)


@pytest.mark.parametrize("rounds", [0, 3])
def test_null_ids_tie_nothing_and_repeated_ids_do(cases, rounds):
    _, rows, table = cases
    got = J.similar_components(table, rounds=rounds).collect()
    known = {(r.doc, r.component) for r in got if r.doc != J.NULL_ID}
    assert known == {(10, 10), (11, 11), (3, 3), (20, 3), (21, 3), (22, 22)}
    assert len(got) == len(rows)
    assert Counter(r.component for r in got if r.doc == J.NULL_ID) == {10: 1, 11: 1, J.NULL_ID: 7}


@pytest.mark.parametrize("rounds", [0, 3])
def test_one_row_of_each_group_of_similar_texts_stays(cases, rounds):
    t, rows, table = cases
    out = J.keep_one_per_component(table, rounds=rounds)
    assert out.columns == table.columns
    kept = sorted(r.nr for r in out.collect())
    texts = [rows[i][1] for i in kept]
    assert {1, 3, 8, 9, 10, 13, 14, 15, 16, 17} <= set(kept)  # smallest ids, lone texts, rows without words
    assert len(kept) == 12 and sum(x in (t[2], near(t[2])) for x in texts) == 1 and texts.count(t[3]) == 1
