"""Line dedup by a sharded minimal perfect hash over repeated line hashes.

A first pass hashes every line's key (128 bits) and aggregates, per distinct hash, the
smallest and largest doc_id and a count. Hashes seen in at least two documents are
the index: they are dealt to shards, and each shard becomes a minimal perfect hash
that addresses compact arrays of fingerprints, counts and owners (the smallest
doc_id). A second pass sends (hash, row, position) probes to the shards; the arrays
answer them in vectorised batches and only the positions to drop travel back. Line
text is never shuffled, joined or collected.

A shard holds about SHARD_KEYS keys whatever the size of the corpus. A hash that makes
up more than one part in HOT_PARTS of all lines (there are at most HOT_PARTS of
them) is copied to HOT_SALTS shards of its own and its probes are spread over them.

Cases: null or empty text is one empty line (kept, joined back as the empty text); keys
under ``min_chars`` code points are never dropped; rows that repeat a doc_id count as
one document and keep their lines alike; a null doc_id counts as a document smaller
than all others (all null ids being one); an empty table gives an empty result; extra
columns are carried along by ``dedup_lines`` and not read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, cut, row_key, shuffle_width, table, worker_lets_go
from gleaner.llm.mph import PerfectHash

SHARD_KEYS = 1 << 16
HOT_PARTS = 1000
HOT_SALTS = 32
NULL_ID = -(1 << 63)
_BLANK_BYTES = BLANKS.encode()


def line_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of a text's lines whose key has at least ``min_chars`` code points."""
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):  # bytes.lower: A-Z only
        key = line.strip(_BLANK_BYTES)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            yield i, key


def _hashed_lines(min_chars: int, with_place: bool):
    """Arrow batches (_row, doc_id, text) -> one row per eligible line."""
    from xxhash import xxh3_128_digest

    def run(batches):
        worker_lets_go()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                digests, rows, ids, places = bytearray(), [], [], []
                for r, d, text in zip(part.column("_row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    d = NULL_ID if d is None else d
                    for i, key in line_keys(text, min_chars):
                        digests += xxh3_128_digest(key)
                        rows.append(r)
                        ids.append(d)
                        places.append(i)
                h = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
                cols = {"h": pa.array(h[:, 0]), "print": pa.array(h[:, 1]), "doc": pa.array(ids, pa.int64())}
                if with_place:
                    cols |= {"_row": pa.array(rows, pa.int64()), "place": pa.array(places, pa.int32())}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def line_index(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, print, owner, n) of every line hash that at least two documents hold."""
    lines = docs.mapInArrow(_hashed_lines(min_chars, False), "h long, print long, doc long")
    counted = lines.groupBy("h", "print").agg(F.min("doc").alias("owner"), F.max("doc").alias("_last"), F.count(F.lit(1)).alias("n"))
    return counted.where("owner < _last").drop("_last")


def _probe(batches):
    """Sorted by (cell, kind): a cell's index rows come first, then its probes."""
    cell, held, index = None, [], None
    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        cells, kinds = cols["cell"], cols["kind"]
        edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(cells)]):
            if a == b:
                continue
            if cells[a] != cell:
                cell, held, index = cells[a], [], None
            keys, prints, docs = (cols[n][a:b].astype(np.int64) for n in ("h", "print", "doc"))
            keys, prints = keys.view(np.uint64), prints.view(np.uint64)
            if kinds[a] == 0:
                held.append((keys, prints, docs, cols["n"][a:b].astype(np.int64)))
                continue
            if not held:
                continue
            if index is None:
                k, p, owner, n = (np.concatenate(x) for x in zip(*held))
                mph = PerfectHash(k, p)
                index = mph, mph.arrange(k, p, owner), mph.arrange(k, p, n)
            mph, owners, counts = index
            at = mph.find(keys, prints)
            drop = (at >= 0) & (counts[np.maximum(at, 0)] > 1) & (owners[np.maximum(at, 0)] != docs)
            if drop.any():
                yield pa.RecordBatch.from_pydict(
                    {"_row": pa.array(cols["_row"][a:b][drop].astype(np.int64)), "place": pa.array(cols["place"][a:b][drop].astype(np.int32))}
                )


def dropped_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_hit_row, places): the positions of the lines that each row loses."""
    spark = docs.sparkSession
    index = cut(line_index(docs, min_chars))
    n_keys, n_lines = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(shuffle_width(spark), -(-n_keys // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    # more than one in HOT_PARTS of the indexed lines: at most HOT_PARTS hashes
    is_hot = F.col("n") * HOT_PARTS > n_lines
    hot = index.where(is_hot).select("h", "print", F.lit(True).alias("hot"))
    salts = F.when(is_hot, F.expr(f"transform(sequence(0, {HOT_SALTS - 1}), s -> cast(s + {shards} as bigint))")).otherwise(F.array(shard))
    entries = index.select(
        F.explode(salts).alias("cell"), F.lit(0).alias("kind"), "h", "print", F.col("owner").alias("doc"), "n",
        F.lit(0).cast("long").alias("_row"), F.lit(0).alias("place"),
    )
    lines = docs.mapInArrow(_hashed_lines(min_chars, True), "h long, print long, doc long, _row long, place int")
    lines = lines.join(F.broadcast(hot), ["h", "print"], "left")
    probes = lines.select(
        F.when(F.col("hot"), F.pmod(F.xxhash64("_row"), F.lit(HOT_SALTS)) + shards).otherwise(shard).alias("cell"),
        F.lit(1).alias("kind"), "h", "print", "doc", F.lit(0).cast("long").alias("n"), "_row", "place",
    )
    dealt = entries.unionByName(probes).repartition(shuffle_width(spark), "cell").sortWithinPartitions("cell", "kind")
    hits = dealt.mapInArrow(_probe, "_row long, place int")
    return hits.groupBy(F.col("_row").alias("_hit_row")).agg(F.collect_list("place").alias("places"))


def kept_text(text: str | None, places) -> tuple[str, int, int]:
    """(the other lines joined, number of lines, number dropped)."""
    lines = (text or "").split("\n")
    if places is None or not len(places):
        return text or "", len(lines), 0
    gone = set(places)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _with_places(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = docs.withColumn("_row", row_key())
    hits = dropped_places(keyed.select("_row", "doc_id", "text"), min_chars)
    return keyed.join(hits.hint("shuffle_hash"), F.col("_row") == F.col("_hit_row"), "left").drop("_hit_row")


def line_dedup_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``."""

    def run(batches):
        worker_lets_go()
        for batch in batches:
            out = [
                (*kept[1:], hashlib.sha256(kept[0].encode("utf-8", "surrogatepass")).hexdigest())
                for kept in map(kept_text, batch.column("text").to_pylist(), batch.column("places").to_pylist())
            ]
            n, d, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(d, pa.int64()), "kept_sha256": pa.array(s, pa.string())}
            )

    joined = _with_places(docs.select("doc_id", "text"), min_chars).select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with its own columns, the text without the repeated lines (null stays null)."""
    names = docs.columns
    joined = _with_places(docs, min_chars)
    kept_udf = F.pandas_udf(_kept_series, "string")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept_udf("text", "places"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in names])


def _kept_series(text, places):
    import pandas as pd

    return pd.Series([kept_text(t, p)[0] for t, p in zip(text, places)], dtype=object)


def q_line_dedup(spark, sf_dir):
    return line_dedup_report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
),
owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT l.doc_id, l.i, l.line, (o.k IS NOT NULL AND o.owner <> l.doc_id) AS gone
  FROM lines l LEFT JOIN owners o ON o.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
