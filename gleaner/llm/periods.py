"""Runs of repeating words, found in tiles per period octave and stitched together.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(12, 2q). Words q apart are identical over ``length - q`` consecutive places, its
match stretch, so a run of octave k (0: periods 1 to 7, then ``4 * 2^k`` to
``8 * 2^k - 1``) has a match stretch of at least 6 (octave 0) or ``4 * 2^k`` words. With
anchors every ``step`` = ``2 * 2^k`` words, such a stretch holds a whole window of
``window`` words that starts at an anchor.

1. Where the texts are read, each octave is tiled. Fingerprints of windows of doubling
   length tell which anchors have their window again one period of the octave later;
   only tiles around those go on. A window can only come again if its halves do, so an
   ordinary text is done after the first octaves.
2. Tiles are dealt out by (document, octave, place) and solved by themselves: one
   Z-function of the words behind the anchor and one of the reversed words before it
   give, for every period of the octave, the match stretch around the anchor as far as
   the tile reaches. A period whose block is a power of a shorter one is not smallest.
3. The fragments are shuffled by (document, period) and stitched: fragments that touch
   belong to one stretch, whose length decides.

A document without any tile is complete after step 1 and its text goes nowhere; the
others carry their words to the end. Memory holds a batch of documents, or one tile
(its size follows the octave; tiles of up to ``GROUP`` neighbouring anchors share
their words). A very long document is solved by many tasks.

Cases: null, empty and blank texts have no words, no run, and the empty string as kept
words; a null doc_id is never rewritten by ``periodic_words``; repeated rows and ids
stay rows of their own (rows are numbered when they are read); an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, shuffle_width, table

LEAST = 12
GROUP = 16
#: words of documents that are tiled together
BATCH_WORDS = 400_000


def octave(k: int) -> tuple[int, int, int, int]:
    """(first period, end of periods, step between anchors, window) of octave k."""
    return (1, 8, 2, 4) if k == 0 else (4 << k, 8 << k, 2 << k, 2 << k)


def z_function(words: list[int]) -> list[int]:
    """For every place, how many words from there on equal the words from the start."""
    n = len(words)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve_anchor(words: list[int], c: int, k: int, base: int = 0) -> list[tuple[int, int, int]]:
    """(period, start, end) of match stretches of octave k around anchor c, as far as its tile reaches.

    ``base`` is the tile's place in the document: at 0 nothing can come before the tile."""
    first, end, step, window = octave(k)
    reach, back = window + step, min(step, c)
    ahead = z_function(words[c : c + reach + end])
    found = [q for q in range(first, min(end, len(ahead))) if ahead[q] >= window]
    if not found:
        return []
    # a block that is a power of its first d words: d divides q and the block agrees with itself d words on
    powers = set()
    for d in range(1, found[-1] // 2 + 1):
        if ahead[d] >= found[0] - d:
            powers.update(q for q in found if q > d and q % d == 0 and ahead[d] >= q - d)
    # the reversed words up to the anchor against the reversed words up to one period later
    behind = z_function([*words[c - back : c][::-1], -1, *words[c - back : c + end - 1][::-1]]) if back else []
    out = []
    for q in found:
        if q in powers:
            continue
        f, b = min(ahead[q], reach), 0
        if back:
            # place of word c - 1 + q in the reversed words, which begin at the last word of the tile's part
            last = min(c + end - 1, len(words)) - 1
            b = min(behind[back + 1 + last - (c - 1 + q)], back)
        whole = f < reach and (b < back or base + c == back)
        if not whole or f + b >= max(q, LEAST - q):
            out.append((q, c - b, c + f))
    return out


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit fingerprint of two others."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def candidate_anchors(words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yields (octave, anchors) over concatenated documents: anchors whose window comes again
    one period of the octave later in the same document. ``starts`` and ``ends`` hold every
    word's document bounds."""
    size = len(words)
    prints = mixed(words.astype(np.uint64) + np.uint64(1), starts.astype(np.uint64))
    active = np.arange(size)
    length = 1

    def doubled(active, length):
        ok = np.zeros(size + 1, bool)
        ok[active] = True
        places = active[(active + 2 * length <= ends[active]) & ok[np.minimum(active + length, size)]]
        prints[places] = mixed(prints[places], prints[places + length])
        return places

    def repeated(active):
        """Active places in order of (fingerprint, place), those alone left out, with their group's number."""
        order = active[np.argsort(prints[active], kind="stable")]
        p = prints[order]
        new = np.ones(len(order), bool)
        new[1:] = p[1:] != p[:-1]
        alone = new & np.append(new[1:], True)
        return order[~alone], np.cumsum(new)[~alone]

    k = 0
    while len(active):
        first, end, step, window = octave(k)
        while length < window:
            active, length = doubled(active, length), 2 * length
        order, group = repeated(active)
        if not len(order):
            return
        line = group * np.int64(size + 1) + order
        mine = (order - starts[order]) % step == 0
        at, g = order[mine], group[mine]
        after = np.searchsorted(line, g * np.int64(size + 1) + at + first)
        hit = after < len(line)
        hit[hit] = line[after[hit]] < g[hit] * np.int64(size + 1) + at[hit] + end
        if hit.any():
            yield k, np.sort(at[hit])
        active = np.sort(order)
        k += 1


def periodic_words(doc_id: int | None, words: list) -> list:
    """The words with a periodic tail planted by the row's own number (one row in ten)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


TILED = "row long, doc_id long, words binary, collapsed string, octave int, place long, base long, anchors array<int>, tile binary"
_TILED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("collapsed", pa.string()), ("octave", pa.int32()), ("place", pa.int64()),
    ("base", pa.int64()), ("anchors", pa.list_(pa.int32())), ("tile", pa.binary()),
])
FRAGMENTS = "row long, period long, start long, end long"
_FRAGMENTS = pa.schema([(n, pa.int64()) for n in ("row", "period", "start", "end")])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def tile_rows(docs: list[tuple]) -> list[tuple]:
    """One row per (row, doc_id, words) document, and one per tile that may hold a run."""
    numbers: dict[bytes, int] = {}
    sizes = [len(w) for _, _, w in docs]
    flat = np.array([numbers.setdefault(x, len(numbers)) for _, _, w in docs for x in w], np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    starts, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    tiles = []
    for k, anchors in candidate_anchors(flat, starts, ends):
        first, end, step, window = octave(k)
        owner = np.searchsorted(bounds, anchors, side="right") - 1
        # neighbouring anchors share a tile, up to GROUP of them
        fresh = np.ones(len(anchors), bool)
        fresh[1:] = (np.diff(anchors) != step) | (np.diff(owner) != 0)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(anchors)), 0))
        fresh |= (np.arange(len(anchors)) - run) % GROUP == 0
        cuts = np.flatnonzero(fresh)
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(anchors)]):
            d, low, high = int(owner[i]), int(anchors[i]), int(anchors[j - 1])
            begin, stop = int(bounds[d]), int(bounds[d + 1])
            # one step back, or to the document's first word
            base = max(begin, low - step)
            tile = flat[base : min(stop, high + window + step + end)]
            tiles.append((docs[d][0], None, None, None, k, low - begin, base - begin, (anchors[i:j] - base).tolist(), tile.astype("<i4").tobytes()))
    tiled = {t[0] for t in tiles}
    out = []
    for row, doc_id, words in docs:
        body = b" ".join(words)
        out.append((row, doc_id, body, None, None, None, None, None, None) if row in tiled else (row, doc_id, None, hashlib.sha256(body).hexdigest(), None, None, None, None, None))
    return out + tiles


def tile_documents(docs: DataFrame, rewrite=None) -> DataFrame:
    """Documents and tiles. A document without tiles has ``collapsed``, the digest of its words; others their words."""

    def run(batches):
        row, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()  # bytes split at exactly \x20 and \x09 to \x0D
                held.append((row, doc_id, rewrite(doc_id, words) if rewrite else words))
                row, size = row + 1, size + len(words)
                if size >= BATCH_WORDS or len(held) >= 4096:
                    yield _rows(tile_rows(held), _TILED)
                    held, size = [], 0
        if held:
            yield _rows(tile_rows(held), _TILED)

    return docs.select("doc_id", "text").mapInArrow(run, TILED)


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """Match stretches, as fragments, of every tile by itself."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for t in batch.slice(i, 256).to_pylist():
                    words = np.frombuffer(t["tile"], "<i4").tolist()
                    found = {x for c in t["anchors"] for x in solve_anchor(words, c, t["octave"], t["base"])}
                    rows += [(t["row"], q, t["base"] + s, t["base"] + e) for q, s, e in found]
                yield _rows(rows, _FRAGMENTS)

    width = shuffle_width(tiles.sparkSession)
    return tiles.select("row", "octave", "place", "base", "anchors", "tile").repartition(width, "row", "octave", "place").mapInArrow(run, FRAGMENTS)


def stitch(fragments: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs (row, start, length, period): fragments of a document and period that touch are one match stretch."""
    by = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = marked.withColumn("stretch", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("row", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = whole.select("row", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))


def documents_with_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """Per document: row, doc_id, words (only if some tile was solved), collapsed (digest of the words otherwise),
    and its runs as array<struct<start, period, length>> in order of start and period.

    Tiles and documents come from one pass over the texts, written to the shared folder."""
    tiled = cut(tile_documents(docs, rewrite))
    runs = stitch(solve_tiles(tiled.where(F.col("octave").isNotNull())))
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    documents = tiled.where(F.col("octave").isNull()).select("row", "doc_id", "words", "collapsed")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    done = documents.where(F.col("words").isNull()).withColumn("runs", none)
    open_ = documents.where(F.col("words").isNotNull()).join(listed, "row", "left").withColumn("runs", F.coalesce("runs", none))
    return done.unionByName(open_)


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_REPORT = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", ")])


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when every run (start, period, length) keeps its first period only."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def report(found: DataFrame) -> DataFrame:
    """The longest run, and digests of all runs and of the text with its repetitions collapsed."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for d in batch.slice(i, 256).to_pylist():
                    runs = [(r["start"], r["period"], r["length"]) for r in d["runs"]]
                    collapsed = d["collapsed"] or hashlib.sha256(kept_words(d["words"].split(), runs)).hexdigest()
                    listing = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
                    best = (None,) * 4
                    if runs:
                        s, q, n = min(runs, key=lambda r: (-r[2], r[0], r[1]))
                        best = (s, n, q, 1000 * n // q)
                    rows.append((d["doc_id"], len(runs), *best, hashlib.sha256(listing.encode()).hexdigest(), collapsed))
                yield _rows(rows, _REPORT)

    return found.select("doc_id", "words", "collapsed", "runs").mapInArrow(run, REPORT)


def q_periods(spark, sf_dir):
    return report(documents_with_runs(table(spark, sf_dir, "documents"), periodic_words))
