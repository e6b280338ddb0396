"""Merkle manifest of a dataset: a content-addressed store of nodes, and proofs by descent.

Every row is a leaf, the SHA-256 of its fields. Per source the leaves, in order of
doc_id, are joined 16 at a time into nodes until one is left, the source's subroot; the
subroots, in order of source, are joined likewise into the root. A node's digest is the
SHA-256 of its children's digests (hex text) one after another.

``build`` stores one record per distinct node: its digest and its children's digests.
``descend`` answers requests for leaves from that store alone: it starts with the root,
looks up the children of every requested node by digest, goes on with the ones that the
digits (base 16) of the requested ranks choose, and notes the others, left and right of
the chosen one, as a segment of the path. All requests below a node share its path, so a
level moves one row per requested node, not per leaf. Paths are collected from the root
down and reversed at the end: a proof lists siblings from the leaf up.

Ranks come from a range partitioning with offsets (``operators.ranking``), so a source
that holds a third of all rows is many tasks; every node has at most 16 children.

Cases: a null field counts as ``-``, so null and empty texts differ; null doc_ids come
first in their source, rows of one doc_id follow by digest; equal rows are equal leaves
at neighbouring ranks, each with its own proof; a null source is a source of its own,
first in order; one source's subroot is the root; a very long text is hashed where it is
read and goes nowhere; an empty table gives an empty store and result; extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, table
from gleaner.operators.ranking import row_number_within

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BITS = 4
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's size in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row's fields; ``changed`` replaces some of them."""
    return digest(*(field((changed or {}).get(name, F.col(name))) for name in FIELDS))


@dataclass
class Manifest:
    """leaves(src, rank, leaf, ...), sources(src, n, depth, subroot), nodes(digest, children), and the root."""

    leaves: DataFrame
    sources: DataFrame
    nodes: DataFrame
    top_depth: int
    root: str | None


def depth_of(n: Column) -> Column:
    """Levels above n ordered nodes: the digits (base 16) of the last rank, none for one node."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 16)))


def joined(level: DataFrame) -> DataFrame:
    """Nodes (src, depth, rank, children) over the nodes (src, depth, rank, digest) of a level, 16 at a time."""
    of = F.sort_array(F.collect_list(F.struct("rank", "digest")))
    up = level.groupBy("src", "depth", F.shiftright("rank", BITS).alias("rank")).agg(of.alias("of"))
    return up.select("src", "depth", "rank", F.col("of.digest").alias("children"), F.sha2(F.array_join("of.digest", ""), 256).alias("digest"))


def build(rows: DataFrame, keep: tuple[str, ...] = ()) -> Manifest:
    """The manifest of rows (doc_id, source, leaf, and columns to keep with the leaves).

    Every level is written to the shared folder; a level has a 16th of the rows below it."""
    ordered = row_number_within(rows.select("source", "doc_id", "leaf", *keep), ["source"], [F.col("doc_id"), F.col("leaf")])
    counts = cut(ordered.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    sources = cut(row_number_within(counts, [], [F.col("source")]).select("source", "n", (F.col("rn") - 1).alias("src"), depth_of(F.col("n")).alias("depth")))
    of = sources.select(F.col("source").alias("_source"), "src", "depth")
    leaves = cut(ordered.join(of, F.col("source").eqNullSafe(F.col("_source"))).select("src", (F.col("rn") - 1).alias("rank"), "depth", "doc_id", "leaf", *keep))

    records, tops = [], []
    level = leaves.select("src", "rank", "depth", F.col("leaf").alias("digest"))
    depths = sources.agg(F.max("depth"), F.count(F.lit(1))).first()
    for height in range((depths[0] or 0) + 1):
        tops.append(level.where(F.col("depth") == height).select("src", "digest"))
        if height < (depths[0] or 0):
            nodes = cut(joined(level.where(F.col("depth") > height)))
            records.append(nodes.select("digest", "children"))
            level = nodes.select("src", "rank", "depth", "digest")
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    sources = cut(sources.join(subroots.withColumnRenamed("digest", "subroot"), "src"))

    top_depth, n = 0, depths[1]
    level = sources.select(F.lit(0).alias("src"), F.lit(0).alias("depth"), F.col("src").alias("rank"), F.col("subroot").alias("digest"))
    while n > 1:
        level = cut(joined(level))
        records.append(level.select("digest", "children"))
        level, n, top_depth = level.drop("children"), -(-n >> BITS), top_depth + 1
    root = level.first()
    nodes = rows.sparkSession.createDataFrame([], "digest string, children array<string>")
    for r in records:
        nodes = nodes.unionByName(r)
    # the store is addressed by content: equal nodes are one record
    return Manifest(leaves, sources, cut(nodes.dropDuplicates(["digest"])), top_depth, root["digest"] if root else None)


def chosen(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """All children of the frontier's nodes (src, rank, digest, path), found by digest, with their path segments."""
    found = frontier.join(nodes, "digest").drop("digest")
    at = F.col("at")
    segment = F.struct(
        F.array_join(F.slice("children", F.lit(1), at), "").alias("before"),
        F.array_join(F.slice("children", at + 2, F.size("children")), "").alias("after"),
    )
    child = found.select("*", F.posexplode("children").alias("at", "digest"))
    return child.withColumn("path", F.concat("path", F.array(segment))).withColumn("rank", F.shiftleft("rank", BITS) + at).drop("at", "children")


def requested(children: DataFrame, requests: DataFrame, shift: int) -> DataFrame:
    """Those of the children that lie on the way to a requested (src, rank)."""
    return children.join(requests.select("src", F.shiftright("rank", shift).alias("rank")).distinct(), ["src", "rank"], "left_semi")


def descend(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The last nodes above the requested leaves (src, rank): (src, rank, digest, path, subroot, depth).

    ``path`` holds the segments from the root down to the node. A source of one leaf has
    its subroot here, with depth 0."""
    spark = requests.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], f"src long, rank long, digest string, path {PATH}, subroot string, depth int")
    spread = requests.select("src", F.col("src").alias("rank")).distinct().select(F.lit(0).cast("long").alias("src"), "rank")
    frontier = spark.createDataFrame([(0, 0, manifest.root, [])], f"src long, rank long, digest string, path {PATH}")
    for height in range(manifest.top_depth, 0, -1):
        frontier = cut(requested(chosen(frontier, manifest.nodes), spread, BITS * (height - 1)))
    frontier = frontier.select(F.col("rank").alias("src"), F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"))
    frontier = frontier.join(manifest.sources.select("src", "depth"), "src")
    if manifest.top_depth == 0:
        frontier = frontier.join(requests.select("src").distinct(), "src", "left_semi")
    deepest = manifest.sources.agg(F.max("depth")).first()[0]
    last = None
    for height in range(deepest, 0, -1):
        # sources of this depth enter here; the frontier stands ``height`` levels above the leaves
        here = frontier.where(F.col("depth") == height).select("src", "rank", "digest", "path", "subroot")
        here = here if last is None else here.unionByName(last)
        if height == 1:
            last = here
        else:
            last = cut(requested(chosen(here, manifest.nodes), requests, BITS * (height - 1)))
    alone = frontier.where(F.col("depth") == 0).select("src", "rank", "digest", "path", "subroot").withColumn("depth", F.lit(0))
    return alone if last is None else alone.unionByName(last.withColumn("depth", F.lit(1)))


def proofs(manifest: Manifest, requests: DataFrame, keep: list[str]) -> DataFrame:
    """Per requested leaf (src, rank, depth, leaf, and columns to keep, as in ``manifest.leaves``): subroot, and
    ``path``, its segments (siblings before and after it) from the leaf up to the root."""
    above = descend(manifest, requests).join(manifest.nodes, "digest", "left")
    # a leaf's row is small and its parent's path long: leaves gather at their parent, which is read once
    several, single = requests.where(F.col("depth") > 0), requests.where(F.col("depth") == 0)
    leaf = F.struct(F.col("rank").bitwiseAND((1 << BITS) - 1).cast("int").alias("at"), "leaf", *keep)

    def gathered(of: DataFrame, shift: int) -> DataFrame:
        return of.groupBy("src", F.shiftright("rank", shift).alias("rank")).agg(F.collect_list(leaf).alias("leaves"))

    parents = above.where(F.col("depth") > 0).join(gathered(several, BITS), ["src", "rank"])
    alone = above.where(F.col("depth") == 0).join(gathered(single, 0), ["src", "rank"])
    each = parents.unionByName(alone).select("subroot", "path", "children", F.explode("leaves").alias("l"))
    at = F.col("l.at")
    own = F.struct(
        F.array_join(F.slice("children", F.lit(1), at), "").alias("before"),
        F.array_join(F.slice("children", at + 2, F.size("children")), "").alias("after"),
    )
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(own)))
    return each.select("l.leaf", *[f"l.{k}" for k in keep], "subroot", F.reverse(path).alias("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's sibling digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def q_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = F.when(tampered, leaf_digest({"text": F.translate("text", UPPER, LOWER)})).otherwise(leaf_digest())
    manifest = build(docs.select("doc_id", "source", leaf_digest().alias("leaf"), other.alias("other")), ("other",))
    asked = manifest.leaves.select("src", "rank", "depth", "leaf", "doc_id", "other")
    proved = proofs(manifest, asked, ["doc_id", "other"]).withColumn("folded_root", folded(F.col("other"), F.col("path")))
    root = F.lit(manifest.root).cast("string")
    return proved.select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def _sql(levels: int = 7, top_levels: int = 7) -> str:
    """DuckDB SQL: bottom-up levels and windows of 16 (sources of up to 16^levels leaves)."""
    crc = (
        "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), "
        "lambda i: [ascii(substring(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    )

    def f(x: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    def h(text: str) -> str:
        return "sha256(" + " || ".join(f(x) if x != "text" else f(text) for x in FIELDS) + ")"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src
  FROM (SELECT doc_id, source, {h('text')} AS leaf,
          CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN {h(low)} ELSE {h('text')} END AS other FROM documents)
),
a0 AS (SELECT src, rank, leaf AS digest FROM leaves)"""]

    def climb(kind: str, level: int) -> str:
        """Level ``level`` + 1, and each node's siblings before and after it on this level."""
        n, m = f"{kind}{level}", f"{kind}{level + 1}"
        w = "OVER (PARTITION BY src, rank // 16 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        v = "OVER (PARTITION BY src, rank // 16 ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        return f"""{n}s AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, coalesce(string_agg(digest, '') {w}, '') AS before,
  coalesce(string_agg(digest, '') {v}, '') AS after FROM {n}),
{m} AS (SELECT src, rank // 16 AS rank, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY rank)) END AS digest
  FROM {n}s GROUP BY src, rank // 16)"""

    parts += [climb("a", i) for i in range(levels)]
    parts.append(f"b0 AS (SELECT 0 AS src, src AS rank, digest FROM a{levels})")
    parts += [climb("b", i) for i in range(top_levels)]

    fold, proof, join = "l.other", [], []
    steps = []
    for kind, key, n in (("a", "rank", levels), ("b", "src", top_levels)):
        for i in range(n):
            t = f"{kind}{i}s"
            on = f"{t}.src = l.src AND {t}.rank = l.rank // {16 ** i}" if kind == "a" else f"{t}.rank = l.src // {16 ** i}"
            join.append(f"JOIN {t} ON {on}")
            proof.append(f"{t}.before || {t}.after")
            steps.append(t)
    # one CTE per fold step keeps the expression small
    carried = ", ".join(f"{t}.n AS n_{t}, {t}.before AS b_{t}, {t}.after AS a_{t}" for t in steps)
    parts.append(f"p0 AS (SELECT l.doc_id, l.leaf, l.src, {fold} AS fold, sha256({' || '.join(proof)}) AS proof_sha256, {carried} FROM leaves l {' '.join(join)})")
    for i, t in enumerate(steps):
        parts.append(f"p{i + 1} AS (SELECT * REPLACE (CASE WHEN n_{t} = 1 THEN fold ELSE sha256(b_{t} || fold || a_{t}) END AS fold) FROM p{i})")
    last = f"p{len(steps)}"
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT p.doc_id, p.leaf, a{levels}.digest AS subroot, b{top_levels}.digest AS root, p.proof_sha256, p.fold AS folded_root, p.fold = b{top_levels}.digest AS verified"
        + f"\nFROM {last} p JOIN a{levels} USING (src) CROSS JOIN b{top_levels}"
    )


SQL = _sql()
