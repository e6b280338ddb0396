from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _row string, taken string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty, blank, very long and repeated texts, with extra columns of clashing names."""
    rng = random.Random(5)
    long_text = words(rng, 30_000)
    base = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, "one two", None, "b", 7),
        (5, long_text, "en", "b", len(long_text)), (6, long_text, "en", "c", len(long_text)), (7, "one two", "en", "c", 7),
        (7, "one two", "en", "c", 7), (None, "no id here at all, sorry", "en", "c", 24), (9, "Línea repetida aquí\nother line\nLÍNEA x", "es", "d", 9),
        (10, "  línea repetida AQUÍ\nOther LINE \nshort\nshort", "es", "d", 9), (11, "LíNEA REPETIDA AQUí\x0b\nother line", "es", None, 9),
    ]
    base += [(20 + i, words(rng, rng.randint(3, 60)) + ".\n" + words(rng, 12), "en", f"s{i % 4}", 1) for i in range(40)]
    return [(*r, "x", "y", "z", "t") for r in base]


@pytest.fixture(scope="session")
def edge_docs(spark, tmp_path_factory):
    """The edge rows as a stored table (operators expect a re-readable input)."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
