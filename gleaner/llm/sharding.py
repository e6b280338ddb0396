"""Sharding by a hierarchical weighted hash tree.

A topology is a tree region -> rack -> shard whose leaves carry weights; an inner
node weighs the sum of its leaves. A row descends from the root: at every level each
child draws ``-ln(u) / weight`` from the hash of (key, child) and the smallest draw
wins, so a child is entered with probability proportional to its weight. A changed
weight alters only the draws of the nodes on its own path: rows move out of or into
that subtree and nowhere else. A shard added as a subtree of its own (a new region)
therefore takes rows only into itself.

Cases: a null key is hashed like any value (all null keys share a shard); equal keys
always share a shard; an empty table gives an empty result; weights of zero or less
are left out of the tree; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import unit_interval

#: rows of a shard are numbered in this many stripes, so no task holds a whole shard
STRIPES = 256


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_topology(n_shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """n_shards equal leaves, per_rack to a rack and racks to a region, filled in order."""
    per_region = racks * per_rack
    return [Leaf(f"region{i // per_region}", f"rack{i % per_region // per_rack}", i) for i in range(n_shards)]


def _children(topology: Iterable[Leaf]) -> dict[str, dict[str, float]]:
    """Node path -> its children's paths and weights; the root is the empty path."""
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for leaf in topology:
        if leaf.weight <= 0:
            continue
        region, rack = f"/{leaf.region}", f"/{leaf.region}/{leaf.rack}"
        for parent, child in (("", region), (region, rack), (rack, f"{rack}/{leaf.shard}")):
            out[parent][child] += leaf.weight
    if not out:
        raise ValueError("a topology needs a shard of positive weight")
    return out


def shard_of(key: Column, topology: Iterable[Leaf], seed: int = 0) -> Column:
    """The shard number that the key's descent through the tree ends in."""
    nodes = _children(topology)
    tree = F.create_map(
        *[
            x
            for parent, kids in nodes.items()
            for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in kids.items()]))
        ]
    )
    at = F.lit("")
    for _ in range(3):
        at = F.array_min(
            F.transform(
                F.element_at(tree, at),
                lambda c: F.struct((-F.ln(unit_interval(F.lit(seed), key, c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")),
            )
        )["node"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], counts_from: DataFrame) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 within each shard.

    ``rows`` and ``counts_from`` (the same rows, without heavy columns) carry ``shard``
    and ``stripe``; each (shard, stripe) is numbered on its own and shifted by the
    counts of the shard's earlier stripes, a table of #shards x STRIPES rows at most.
    """
    cells = counts_from.groupBy(shard, "stripe").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("stripe")) - F.col("_n")
    cells = cells.select(shard, "stripe", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy(shard, "stripe").orderBy(*order))
    return (
        rows.withColumn("_number", number)
        .join(F.broadcast(cells), [shard, "stripe"])
        .withColumn("slot", (F.col("_number") - 1 + F.col("_before")).cast("long"))
        .drop("_number", "_before", "stripe")
    )


def shard_documents(docs: DataFrame, topology: list[Leaf], grown: list[Leaf], seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard under the grown topology.

    A null text has no bytes (size 1, checksum of no bytes).
    """
    key = F.col("doc_id")
    stripe = F.pmod(F.xxhash64(F.lit("stripe"), key), F.lit(STRIPES)).cast("int").alias("stripe")
    placed = [shard_of(key, topology, seed).alias("shard"), stripe]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        *placed,
        shard_of(key, grown, seed).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], docs.select(*placed)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def q_shards(spark, sf_dir):
    """Eight shards in two regions of two racks; the ninth opens a region of its own."""
    from gleaner.llm.common import table

    eight = regular_topology(8)
    return shard_documents(table(spark, sf_dir, "documents"), eight, [*eight, Leaf("region2", "rack0", 8)])
