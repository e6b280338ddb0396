"""The pipeline's stages: columns, order, and what each takes out."""

from __future__ import annotations

import ast
import os

import corpus_pipeline as C
from gleaner.llm.queries import QUERIES, SQL
from tests.conftest import ROOT, SF001, SF0001


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF001}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if i < len(C.STAGES) - 1:
            assert docs.schema == first.schema
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] != counts[3]
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_edge_rows_pass_every_stage(spark, edge_docs, no_docs, tmp_path):
    for k, table in enumerate((edge_docs, no_docs)):
        docs = table
        for name, stage in C.STAGES:
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, SF0001).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == table.columns
        assert (docs.count() == 0) == (k == 1)


def test_run_is_the_stages_one_after_another(spark):
    out = C.run(spark, SF0001)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_queries_are_registered_once_per_operator():
    numbers = [int(k[2:].split("_")[0]) for k in QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(SQL) <= set(QUERIES)


def test_nothing_else_imports_the_subpackage():
    for folder in ("gleaner", "oracle", "tools"):
        for at, _, names in os.walk(os.path.join(ROOT, folder)):
            if "llm" in at.split(os.sep):
                continue
            for name in names:
                if name.endswith(".py"):
                    tree = ast.parse(open(os.path.join(at, name)).read())
                    used = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                    assert not any(u.startswith("gleaner.llm") or u == "corpus_pipeline" for u in used), name
