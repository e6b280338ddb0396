"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector (at unit length) is hashed by ``tables`` groups of ``bits`` projections on
Gaussian directions, each cut into steps of ``width``. A query visits its own bucket
and then perturbed ones in the order of their estimated success, the smallest sum of
squared distances to the step borders that a perturbation crosses. Within the visited
buckets the exact cosine is computed in double precision and tables are merged by it.

How many buckets a query visits is fitted on a bounded sample (``sample`` vectors,
those with the smallest hash): the fewest probes that find ``recall`` of the sample's
own neighbours, which lie farther apart than those of the whole table.

Equal vectors are searched once and stand for their ``k + 1`` smallest ids, which is
all that a result can hold, so any number of copies costs one row. Buckets with many
queries or vectors are dealt to cells of bounded size (``CELL_QUERIES`` queries by
``CELL_VECTORS`` vectors); queries of a cell are held in memory and vectors stream past.

Cases: vectors that are null, of length zero, hold null or non-finite components or
have another dimension than most take no part, as candidate or query; null ids take
no part; a repeated row counts once; fewer than ``k`` candidates give fewer rows; ties go
to the smaller id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import cut, shuffle_width, table

BITS, TABLES, WIDTH = 6, 8, 2.0
SAMPLE, SAMPLE_QUERIES = 4096, 128
CELL_QUERIES, CELL_VECTORS = 2048, 1 << 16


def perturbations(fractions: np.ndarray, n: int) -> list[tuple[tuple[int, int], ...]]:
    """The first ``n`` perturbation sets for one hash group, best estimated success first.

    ``fractions`` are the positions within the steps (0 to 1). A step down costs the
    square of the distance to the lower border, a step up that to the upper one; sets
    are enumerated in order of their summed cost by shifting and expanding a heap.
    """
    moves = sorted([(float(f) ** 2, j, -1) for j, f in enumerate(fractions)] + [(float(1 - f) ** 2, j, 1) for j, f in enumerate(fractions)])
    out: list[tuple] = [()]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < n:
        cost, chosen = heapq.heappop(heap)
        if len({moves[i][1] for i in chosen}) == len(chosen):
            out.append(tuple((moves[i][1], moves[i][2]) for i in chosen))
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return out


class PStableHash:
    def __init__(self, dim: int, bits: int = BITS, tables: int = TABLES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.tables, self.width = bits, tables, width
        # unit vectors project with a spread of 1 whatever their dimension
        self.directions = rng.standard_normal((dim, tables * bits))
        self.shifts = rng.uniform(0, width, tables * bits)
        self.mix = rng.integers(1, 1 << 62, bits, dtype=np.int64) | 1

    def places(self, units: np.ndarray) -> np.ndarray:
        at = (units @ self.directions) + self.shifts
        return (at / self.width).reshape(len(units), self.tables, self.bits)

    def buckets(self, steps: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (steps.astype(np.int64) * self.mix).sum(-1)

    def probes(self, place: np.ndarray, n: int) -> np.ndarray:
        """Bucket numbers (tables x up to n) that one query visits; short lists repeat their first."""
        out = np.empty((self.tables, n), np.int64)
        for t in range(self.tables):
            base = np.floor(place[t]).astype(np.int64)
            sets = perturbations(place[t] - base, n)
            steps = np.repeat(base[None], n, 0)
            for i, s in enumerate(sets):
                for j, d in s:
                    steps[i, j] += d
            out[t] = self.buckets(steps)
        return out


def units_of(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fitted_probes(hashing: PStableHash, vectors: np.ndarray, k: int, recall: float) -> int:
    """The fewest probes (by doubling) that find ``recall`` of the sample's own k nearest."""
    limit = 3**hashing.bits
    if len(vectors) < 2:
        return min(8, limit)
    u = units_of(vectors)
    q = np.arange(min(SAMPLE_QUERIES, len(u)))
    score = u[q] @ u.T
    score[q, q] = -2
    near = np.argsort(-score, axis=1)[:, : min(k, len(u) - 1)]
    places = hashing.places(u)
    buckets = hashing.buckets(np.floor(places))
    n = 8
    while True:
        found = 0
        for i in q:
            probes = hashing.probes(places[i], n)
            found += sum(any(buckets[j, t] in probes[t] for t in range(hashing.tables)) for j in near[i])
        if found >= recall * near.size or n >= limit:
            return n
        n = min(2 * n, limit)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


_INDEX = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
_INDEX_SQL = "t int, bucket long, id long, vector array<double>"


def _hashed(hashing: PStableHash, probes: int):
    """(cid, embedding) -> a row per table (probes = 0), or per table and visited bucket."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512 if probes else 4096):
                part = batch.slice(start, 512 if probes else 4096)
                v = _matrix(part.column("embedding"))
                places = hashing.places(units_of(v))
                if probes:
                    found = np.stack([hashing.probes(p, probes) for p in places])  # rows x tables x probes
                else:
                    found = hashing.buckets(np.floor(places))[:, :, None]
                for t in range(hashing.tables):
                    for i in range(0, len(v), 64 if probes else len(v)):
                        f = found[i : i + 64, t] if probes else found[:, t]
                        rows = np.repeat(np.arange(i, i + len(f)), f.shape[1])
                        keep = np.ones(len(rows), bool)
                        if probes:  # a short list repeats its first bucket
                            first = np.concatenate([np.isin(np.arange(f.shape[1]), np.unique(x, return_index=True)[1]) for x in f])
                            keep = first
                        rows, b = rows[keep], f.ravel()[keep]
                        if not len(rows):
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows), t, np.int32)), pa.array(b), part.column("cid").take(pa.array(rows)).cast(pa.int64()),
                                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * v.shape[1]), pa.array(v[rows].ravel())),
                            ],
                            schema=_INDEX,
                        )

    return run


def _rerank(keep: int):
    """Cells sorted queries first; the best ``keep`` classes of each query, merged per task."""

    def run(batches):
        best: dict[int, dict[int, float]] = {}
        cell, ids, held = None, [], []
        q_ids = q_units = None

        def flushed():
            rows = [(q, c, s) for q, found in best.items() for c, s in found.items()]
            best.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query", "cid", "score"])

        for batch in batches:
            cells = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t", "bucket", "qc", "vc", "kind")], 1)
            vectors, all_ids = _matrix(batch.column("vector")), batch.column("id").to_numpy()
            edges = np.flatnonzero((np.diff(cells, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(cells)]):
                if a == b:
                    continue
                if cell != (at := tuple(cells[a, :4])):
                    cell, ids, held, q_ids = at, [], [], None
                if cells[a, 4] == 0:
                    ids.append(all_ids[a:b])
                    held.append(units_of(vectors[a:b]))
                    continue
                if not held:
                    continue
                if q_ids is None:
                    q_ids, q_units = np.concatenate(ids), np.concatenate(held)
                for i in range(a, b, 8192):
                    c_ids = all_ids[i : min(b, i + 8192)]
                    score = q_units @ units_of(vectors[i : min(b, i + 8192)]).T
                    n = min(keep, score.shape[1])
                    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    edge = np.take_along_axis(score, top, 1).min(1)
                    for r, q in enumerate(q_ids.tolist()):
                        mine = best.setdefault(q, {})
                        # ties at the edge stay: the smallest ids among them may count
                        cols = top[r] if n == score.shape[1] else np.flatnonzero(score[r] >= edge[r] - 1e-12)
                        for c, s in zip(c_ids[cols].tolist(), score[r, cols].tolist()):
                            mine[c] = max(s, mine.get(c, -2.0))
                        if len(mine) > 4 * keep:
                            best[q] = dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[: 2 * keep])
                if len(best) > 50_000:
                    yield flushed()
        yield flushed()

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    )
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (most["d"] if most else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, bits: int = BITS, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` picks."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    firsts = rows.distinct().withColumn("_n", nth).where(F.col("_n") <= k + 1)
    classes = cut(firsts.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(is_query).distinct().join(classes.select("embedding", "cid"), "embedding")
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")))

    taken = classes.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    dim = len(taken[0]["embedding"]) if taken else 1
    hashing = PStableHash(dim, bits, tables, width)
    probes = fitted_probes(hashing, np.array([r["embedding"] for r in taken], np.float64).reshape(-1, dim), k, recall)

    base = classes.select("cid", "embedding")
    spread = base.repartition(shuffle_width(spark), "cid")
    index = spread.mapInArrow(_hashed(hashing, 0), _INDEX_SQL)
    wanted = base.join(asked.select(F.col("qcid").alias("cid")).distinct(), "cid", "left_semi").repartition(shuffle_width(spark), "cid")
    visits = wanted.mapInArrow(_hashed(hashing, probes), _INDEX_SQL)

    sizes = index.select("t", "bucket", F.lit(1).alias("v"), F.lit(0).alias("q")).unionByName(visits.select("t", "bucket", F.lit(0).alias("v"), F.lit(1).alias("q")))
    sizes = sizes.groupBy("t", "bucket").agg(F.sum("v").alias("nv"), F.sum("q").alias("nq")).where("nv > 0 and nq > 0")
    sizes = cut(sizes.select("t", "bucket", F.ceil(F.col("nv") / CELL_VECTORS).alias("vcs"), F.ceil(F.col("nq") / CELL_QUERIES).alias("qcs")))

    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    vector_rows = index.join(sizes, ["t", "bucket"]).select("t", "bucket", every("qcs").alias("qc"), chunk("vcs").alias("vc"), F.lit(1).alias("kind"), "id", "vector")
    query_rows = visits.join(sizes, ["t", "bucket"]).select("t", "bucket", chunk("qcs").alias("qc"), every("vcs").alias("vc"), F.lit(0).alias("kind"), "id", "vector")
    cell = ["t", "bucket", "qc", "vc"]
    dealt = vector_rows.unionByName(query_rows).repartition(shuffle_width(spark), *cell).sortWithinPartitions(*cell, "kind")
    found = dealt.mapInArrow(_rerank(k + 1), "query long, cid long, score double")

    merged = found.groupBy("query", "cid").agg(F.max("score").alias("score"))
    # k + 1 classes hold the k + 1 best rows; ties beyond them cannot be smaller than what a class lists first
    best = merged.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))).where(F.col("_n") <= k + 1)
    listed = best.join(classes.select("cid", "ids"), "cid").select("query", F.explode("ids").alias("vec_id"), "score")
    listed = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id", "score"))).alias("near"))
    out = asked.join(listed, F.col("qcid") == F.col("query")).select(
        "query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("i", "x")
    )
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def q_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
