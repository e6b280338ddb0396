"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet to the shared folder (``spark.checkpoint.dir``) and reads it
back for the next, so a lost executor costs at most the running stage. All but the
last stage return the columns of ``documents``.

Rows without text pass through the filters; repeated rows are treated as the operators
state; an empty table gives an empty result with the last stage's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import importable, table
from gleaner.llm.jaccard_join import keep_one_per_component
from gleaner.llm.line_dedup import dedup_lines
from gleaner.llm.mixing import WEIGHTS, mix_stage
from gleaner.llm.packing import pack_documents, tokenizer_file
from gleaner.llm.toxicity import reject_toxic
from gleaner.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    importable(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the smallest doc_id that holds them."""
    importable(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    importable(spark)
    return keep_one_per_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: rows are left out or repeated."""
    return mix_stage(docs, WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences."""
    importable(spark)
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: tokenisation and hashing stages cannot be written in SQL; tests check each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
