"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

MAX_ROUNDS = 60
EDGES_PER_TASK = 20_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, width: int) -> DataFrame:
    """Large star: link a node's larger neighbours to its smallest one; small star: the others.

    A shuffle is written by at most ``width`` tasks, however many the one before it has read.
    """
    near = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = near.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("_a"), F.least("a" if large else "_b", "_b").alias("m")).coalesce(width)
    linked = near.join(lowest, F.col("a") == F.col("_a")).coalesce(width)
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct().coalesce(width)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is its smallest node.

    A round is two joins on node keys; the table never grows beyond the links and is
    cut from its lineage after each round. Rounds grow with the logarithm of the
    longest chain. Only a count and a checksum come to the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state or not now[0]:
            break
        state = now
        width = 1 + now[0] // EDGES_PER_TASK
        edges = cut(_star(_star(edges, True, width), False, width))
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
