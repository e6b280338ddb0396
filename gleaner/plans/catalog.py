
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import analysis_queries, discovery_queries, page_queries, report_queries, state_queries, stream_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery_queries.q_capped_topk(spark, sf_dir)


def all_queries() -> dict:
    out = {}
    out.update(discovery_queries.QUERIES)
    out.update(analysis_queries.QUERIES)
    out.update(report_queries.QUERIES)
    out.update(page_queries.QUERIES)
    out.update(state_queries.QUERIES)
    out.update(stream_queries.QUERIES)
    return out
