"""Similarity join of documents on word shingles with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold. Tokens (shingles) are ordered from rare to frequent by a fixed-size count
sketch of the whole corpus. If a document of n tokens shares at least o of them with
every partner, then its first n - o + l tokens share at least l with the partner's
prefix. l is chosen per document: a longer prefix costs more postings and leaves
fewer candidates to verify, and the estimate of both comes from the sketch. That is
the sieve: sets that share fewer prefix tokens than any partner asks for are out.

The sketch's noise grows with the corpus, so the tokens of the sets that are left are
then counted exactly. Tokens that only one of them holds cannot be shared: they count
as the rarest and do not travel any further, and a set with too many of them has no
partner. In this order a pair must share one token of both prefixes (n - o + 1 tokens).

Equal sets are one class from the start. What the result needs is reachability, so
classes are contracted as links are found: every token's list has a few leaders, and in
each pass a class is compared with the TRIED leaders (of other components) that lead
most of its prefix tokens, which dissolves groups of near copies with a few
comparisons per member. Passes go on, with other leaders, while they still link one
in ``GAIN`` of the classes (which only decides what is found when). The last pass then
takes all candidate pairs between different components; pairs inside one component
cannot change the answer. A posting there knows the shared tokens just before its own,
and a pair is left out where both have one of them: it is met at that token already.

Before sets travel, their parity bits are compared: the own tokens of two sets and the
bits (of 512) in which their shared tokens differ are at most the tokens that only one
of them has, so a pair with too many is no link (an exact bound).

The posting lists are streamed in token order; only lists with two classes survive.
Sets are recomputed from the text for surviving classes only (found by a second,
fixed-size sketch), so text is never shuffled. Shingles and classes are 64-bit hashes.

Cases: null, empty and blank texts have no set and link with nothing; texts with fewer
words than a shingle have one, the whole sequence; ties and repeated rows share a
class. A component is named by its smallest doc_id. Rows that repeat a doc_id are one
document and tie their components together; rows with a null doc_id are documents of
their own, tie nothing, and a component of such rows alone has a null name (two of
them cannot be told apart by it). ``keep_one_per_component`` goes by the texts alone:
ids tie nothing there. An empty table gives an empty result; extra columns are carried
along by ``keep_one_per_component``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, cut, file_row, release, shuffle_width, table, worker_lets_go
from gleaner.llm.components import components
from gleaner.llm.mph import mixed

WORDS = 5
PERCENT = 75
ROUNDS = 12
LEADERS = 4  # per posting list and pass
TRIED = 2  # leaders that a class is compared with in a pass
FAIR = 4  # a leader must lead one in FAIR of the class's lists to be tried
GAIN = 100
FREQUENT = 1 << 16  # tokens of so many sets or more are equally frequent
WINDOW = 8  # shared tokens that a posting of the last pass knows before its own
FEWEST_PER = 10  # a set of n asks for at least n / FEWEST_PER matches, up to FEWEST_MOST
FEWEST_MOST = 8
MAX_MATCHES = 16
SKETCH_BITS = 20
BLOCKS = 64
PARITY_LONGS = 8  # 64-bit words of a set's parity bits
NULL_ID = -(1 << 63)
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18  # bytes of text hashed at a time, some 60 bytes of memory each; a longer text is hashed alone


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand; those of a text longer than a chunk are not kept."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        grown = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        if n <= 2 * _CHUNK:
            self.up, self.down = grown
        return grown


_POWERS = _Powers()


def _word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a buffer that ends in a blank."""
    a = np.frombuffer(buffer, np.uint8)
    word = ~_BLANK[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(a) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum((a.astype(np.uint64) + _U(1)) * down[: len(a)])])
        return starts, mixed((sums[ends] - sums[starts]) * up[starts], 1) ^ mixed((ends - starts).astype(np.uint64), 2)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower: A-Z only
    out: list[np.ndarray] = []
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < _CHUNK):
            size += len(raw[j]) + 1
            j += 1
        starts, h = _word_hashes(b"\n".join(raw[i:j]) + b"\n")
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw[i:j]])
        bounds = np.searchsorted(starts, offsets)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - words + 1)
            joined = np.zeros(n, np.uint64)
            for k in range(words):
                joined += mixed(h[k : k + n], 3 + k) * _U(2 * k + 3)
            joined = mixed(joined, 40)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    out.append(mixed(sum((mixed(h[a + k : a + k + 1], 3 + k) * _U(2 * k + 3) for k in range(b - a)), np.zeros(1, np.uint64)), 41 + int(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        i = j
    return out


def class_of(tokens: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _parts(batches: Iterator, size: int = 512) -> Iterator:
    worker_lets_go()
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


class CountSketch:
    """Counts by the low bits of a hash, sent as compressed blocks and summed by block."""

    size = 1 << SKETCH_BITS
    width = size // BLOCKS
    schema = "block int, counts binary"

    def __init__(self):
        self.counts = np.zeros(self.size, np.uint32)

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.counts, self.slot(hashes), 1) if len(hashes) < 4096 else self._bulk(hashes)

    def _bulk(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount(self.slot(hashes), minlength=self.size).astype(np.uint32)

    def blocks(self) -> list[tuple[int, bytes]]:
        rows = self.counts.reshape(BLOCKS, self.width)
        return [(b, zlib.compress(r.tobytes(), 1)) for b, r in enumerate(rows) if r.any()]

    @classmethod
    def total(cls, blocks: DataFrame) -> np.ndarray:
        """The summed sketch: 2^SKETCH_BITS numbers, whatever the corpus holds."""

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(cls.width, np.int64)
            for raw in pdf["counts"]:
                out += np.frombuffer(zlib.decompress(raw), np.uint32)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

        # blocks of one number are pre-summed in groups, so that no task reads every task's block
        salted = blocks.withColumn("salt", F.pmod(F.hash("counts"), F.lit(16)))
        partial = salted.groupBy("block", "salt").applyInPandas(lambda p: summed(p), cls.schema)
        out = np.zeros((BLOCKS, cls.width), np.uint32)
        for block, raw in partial.groupBy("block").applyInPandas(summed, cls.schema).collect():
            out[block] = np.frombuffer(zlib.decompress(raw), np.uint32)
        return out.ravel()


_KEY = pa.struct([("file", pa.int64()), ("row", pa.int64())])
_SCAN = pa.schema([("doc", pa.int64()), ("key", _KEY), ("cls", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def _scan(words: int):
    """A row per document (doc, key, cls, n), then the sketch of the partition's classes."""

    def run(batches):
        sketch, seen = CountSketch(), set()
        for part in _parts(batches):
            classes, sizes, fresh = [], [], []
            for tokens in shingle_sets(part.column("text").to_pylist(), words):
                classes.append(class_of(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                if len(tokens) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    fresh.append(tokens)
            if fresh:
                sketch.add(np.concatenate(fresh))
            if len(seen) > 1_000_000:
                seen.clear()
            n = len(classes)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key").cast(_KEY), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SCAN)
        blocks = sketch.blocks()
        n = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, _KEY), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())],
            schema=_SCAN,
        )

    return run


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def fewest_matches(n: int) -> int:
    """The fewest matches that a set of n tokens asks for; it grows with n."""
    return min(FEWEST_MOST, max(1, n // FEWEST_PER))


def prefix_of(tokens: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """(the prefix tokens, rare ones first; the number of matches l that they ask for).

    cost(l) = postings in the prefix + n x (postings / l): the second term bounds the
    candidates that reach l matches, each of which costs a comparison of n tokens.
    Frequencies below the sketch's noise count as none, so l starts at a minimum that
    only depends on n.
    """
    n = len(tokens)
    frequency = counts[CountSketch.slot(tokens)]
    order = np.lexsort((tokens, frequency))
    overlap = least_overlap(n, percent)
    options = np.arange(min(fewest_matches(n), overlap), min(MAX_MATCHES, overlap) + 1)
    lengths = n - overlap + options
    postings = np.cumsum(np.maximum(frequency[order[: lengths[-1]]] - noise, 0.0))[lengths - 1]
    matches = int(options[np.argmin(postings + n * postings / options)])
    return tokens[order[: n - overlap + matches]], matches


_POSTING = pa.schema([("token", pa.int64()), ("cls", pa.int64())])


def _postings(counts, noise: float, words: int, percent: int):
    def run(batches):
        known, seen = counts.value, set()
        for part in _parts(batches):
            tokens, classes = [], []
            for s in shingle_sets(part.column("text").to_pylist(), words):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                p, _ = prefix_of(s, known, noise, percent)
                tokens.append(p)
                classes.append(np.full(len(p), c, np.int64))
            if len(seen) > 1_000_000:
                seen.clear()
            if tokens:
                cols = np.concatenate(tokens).view(np.int64), np.concatenate(classes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_POSTING)

    return run


def _shared(batches):
    """Postings sorted by (token, cls) -> those of tokens with two classes, without repeats.

    A batch's last posting waits for the next batch; that is all the state there is.
    """
    n, mark = len(_POSTING), len(_POSTING)
    held = np.empty((0, n + 1), np.int64)  # the posting, and whether it is kept because of the posting before
    for batch in batches:
        rows = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in _POSTING.names] + [np.zeros(batch.num_rows, np.int64)], 1)
        rows = np.concatenate([held, rows])
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
        rows = rows[new]
        same = rows[1:, 0] == rows[:-1, 0]
        rows[1:, mark] |= same
        keep = (rows[:-1, mark] == 1) | same
        held, out = rows[-1:], rows[:-1][keep]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(n)], schema=_POSTING)
    if len(held) and held[0, mark]:
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(n)], schema=_POSTING)


PARITY = [f"g{i}" for i in range(PARITY_LONGS)]
_SET = pa.schema([("cls", pa.int64()), ("tokens", pa.binary())])


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Bit b says whether an odd number of the set's tokens fall on b.

    Tokens that two sets share cancel out, so the bits in which two sets differ are at
    most the tokens that only one of them has.
    """
    odd = np.bincount((tokens % _U(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets_of(wanted_ids, wanted_classes, words: int):
    """Sets of the classes that one sketch may hold, from documents whose id the other may hold."""

    def held(sketch, values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(sketch.value[CountSketch.slot(mixed(values.view(np.uint64), 77))])

    def run(batches):
        seen = set()
        for part in _parts(batches):
            ids = np.array([NULL_ID if d is None else d for d in part.column("doc_id").to_pylist()], np.int64)
            may = held(wanted_ids, ids)
            if not len(may):
                continue
            sets = {class_of(x): x for x in shingle_sets(part.column("text").take(pa.array(may)).to_pylist(), words) if len(x)}
            classes = np.array([c for c in sets if c not in seen], np.int64)
            classes = classes[held(wanted_classes, classes)]
            seen.update(classes.tolist())
            if len(seen) > 1_000_000:
                seen.clear()
            if len(classes):
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([sets[c].tobytes() for c in classes.tolist()], pa.binary())], schema=_SET)

    return run


def _value_blocks(batches):
    sketch = CountSketch()
    for batch in batches:
        sketch._bulk(mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 77))
    blocks = sketch.blocks()
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])


_HELD = pa.schema([("token", pa.int64()), ("node", pa.int64())])


def _held_tokens(batches):
    """(token, node) of every token of the sets (node, tokens)."""
    for part in _parts(batches):
        sets = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
        if sets:
            nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], schema=_HELD)


_COUNTED = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("df", pa.int64())])


def _counted(batches):
    """Rows (token, node) sorted by token -> those of tokens with two nodes, with their number df.

    A list waits until its end is seen; one that reaches FREQUENT rows goes out as it
    comes, with FREQUENT as its number.
    """
    held, frequent = np.empty((0, 2), np.int64), None

    def out(rows, df):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(df)], schema=_COUNTED)

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _HELD.names], 1)])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        sizes = np.diff(starts, append=len(rows))
        df = np.minimum(np.repeat(sizes, sizes), FREQUENT)
        if rows[0, 0] == frequent:
            df[: sizes[0]] = FREQUENT
        last = len(rows) if df[-1] == FREQUENT else starts[-1]
        frequent = rows[-1, 0] if df[-1] == FREQUENT else None
        shared = df[:last] > 1
        yield out(rows[:last][shared], df[:last][shared])
        held = rows[last:]
    if len(held) > 1:
        yield out(held, np.full(len(held), len(held)))


_GATHERED = pa.schema([("node", pa.int64()), ("shared", pa.int64()), ("tokens", pa.binary()), *[(g, pa.int64()) for g in PARITY]])
_GATHERED_DDL = ", ".join(["node long, shared long, tokens binary", *[f"{g} long" for g in PARITY]])


def _gathered(batches):
    """Rows (token, node) sorted by (node, df, token) -> a row per node; its last tokens wait for the next batch."""

    def out(nodes, tokens):
        starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        sets = np.split(tokens.view(np.uint64), starts[1:])
        parity = np.stack([parity_bits(x) for x in sets])
        cols = [pa.array(nodes[starts]), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(parity[:, i]) for i in range(PARITY_LONGS)]], schema=_GATHERED)

    waiting: list[tuple] = []
    for batch in batches:
        nodes, tokens = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "token"))
        if not len(nodes):
            continue
        waiting.append((nodes, tokens))
        if nodes[-1] != waiting[0][0][0]:
            nodes, tokens = (np.concatenate(c) for c in zip(*waiting))
            last = int(np.searchsorted(nodes, nodes[-1]))
            yield out(nodes[:last], tokens[:last])
            waiting = [(nodes[last:], tokens[last:])]
    if waiting:
        yield out(*(np.concatenate(c) for c in zip(*waiting)))


_PREFIX = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("pos", pa.int64()), ("before", pa.list_(pa.int64()))])
_PREFIX_DDL = "token long, node long, pos long, before array<long>"


def _prefixes(percent: int, window: int):
    """(token, node, pos, before) of the shared tokens in each set's prefix.

    Tokens that no other set holds come first in the order and have no list. ``before``
    are the ``window`` shared tokens just before.
    """

    def run(batches):
        for part in _parts(batches):
            tokens, nodes, places, before, sizes = [], [], [], [], []
            for node, n, x in zip(part.column("node").to_pylist(), part.column("n").to_pylist(), part.column("tokens").to_pylist()):
                x = np.frombuffer(x, np.int64)
                own, size = n - len(x), len(x) - least_overlap(n, percent) + 1
                tokens.append(x[:size])
                nodes.append(np.full(size, node, np.int64))
                places.append(np.arange(own + 1, own + size + 1))
                if window:
                    at = np.arange(size)[:, None] - np.arange(window, 0, -1)
                    before.append(x[at[at >= 0]])
                sizes.append(np.minimum(np.arange(size), window))
            if tokens:
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                values = pa.array(np.concatenate(before) if before else np.empty(0, np.int64))
                cols = [pa.array(np.concatenate(c)) for c in (tokens, nodes, places)]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, values)], schema=_PREFIX)

    return run


def _shared_sets(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (node, n, tokens) with only the tokens that two of them hold: (node, n, own, tokens, parity).

    Tokens are in the join's order, rare ones first; own is the number of tokens left
    out, which count as the rarest. Sets with too many of those have no partner.
    """
    width = shuffle_width(sets.sparkSession)
    held = sets.select("node", "tokens").mapInArrow(_held_tokens, "token long, node long")
    counted = held.repartition(width, "token").sortWithinPartitions("token").mapInArrow(_counted, "token long, node long, df long")
    gathered = counted.repartition(width, "node").sortWithinPartitions("node", "df", "token").select("node", "token").mapInArrow(_gathered, _GATHERED_DDL)
    return gathered.join(sets.select("node", "n"), "node").where(100 * F.col("shared") >= percent * F.col("n")).select("node", "n", (F.col("n") - F.col("shared")).alias("own"), "tokens", *PARITY)


def _verify(percent: int):
    def run(batches):
        for part in _parts(batches, 256):
            keep = []
            for x, y, n in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), part.column("n").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (n - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bits leave room for the similarity; no set travels for the others."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("own").alias("o" + x), *[F.col(g).alias(x + g) for g in PARITY])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_agree(percent)).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(_verify(percent), "a long, b long")


def _labelled(docs: DataFrame, words: int, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, key, cls, n) of ``docs`` (doc_id, key, text), and their classes (cls, doc, comp).

    A class is a distinct set; its node is a number of its own, doc its smallest doc_id
    (null if it has none) and comp the smallest node it can be reached from by links.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    scanned = cut(docs.mapInArrow(_scan(words), "doc long, key struct<file:long,row:long>, cls long, n long, block int, counts binary"))
    rows = scanned.where("block is null").select("doc", "key", "cls", "n")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"), F.first("n").alias("n"))
    # numbers are read back from the checkpoint; in shuffles they pack better than hashes
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    counts = CountSketch.total(scanned.where("block is not null").select("block", "counts"))
    shared_counts = sc.broadcast(counts)  # 4 MB, fixed

    docs = docs.select("doc_id", "text")
    postings = docs.mapInArrow(_postings(shared_counts, float(counts.mean()), words, percent), "token long, cls long")
    ordered = postings.repartition(shuffle_width(spark), "token").sortWithinPartitions("token", "cls")
    surviving = ordered.mapInArrow(_shared, "token long, cls long")
    able = cut(_enough(surviving.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).join(classes, "cls"), percent))
    del postings, ordered, surviving
    release(spark)

    wanted = able.select("cls", "node", "n", F.coalesce("doc", F.lit(NULL_ID)).alias("doc"))
    sketch = lambda c: sc.broadcast(CountSketch.total(wanted.select(c).mapInArrow(_value_blocks, CountSketch.schema)))
    sets = cut(docs.mapInArrow(_sets_of(sketch("doc"), sketch("cls"), words), "cls long, tokens binary")
               .join(wanted.select("cls", "node", "n"), "cls").dropDuplicates(["node"]).select("node", "n", "tokens"))
    release(spark)
    sets = cut(_shared_sets(sets, percent))
    release(spark)
    prefixes = lambda window: sets.select("node", "n", "tokens").mapInArrow(_prefixes(percent, window), _PREFIX_DDL)
    posts = cut(prefixes(0).drop("before").join(sets.select("node", "n"), "node"))

    links, labels, last, n_nodes = None, None, False, sets.count()
    for i in range(rounds + 1):
        named = lambda t: t.withColumn("comp", F.col("node")) if labels is None else t.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        open_ = named(posts)
        between = open_.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("token")
        last = last or i == rounds
        if last:
            bits = named(sets.select("node", "n", "own", *PARITY))
            found = _all_pairs(prefixes(WINDOW).join(between, "token", "left_semi").join(bits, "node"), percent)
        else:
            found = _near_bits(_led_pairs(open_ if labels is None else cut(open_.join(between, "token", "left_semi")), i, percent), sets, percent)
        found = cut(_links(found, sets, percent))
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links))
        release(spark)
        if last:
            break
        last = found.count() * GAIN < n_nodes
    return rows, cut(classes.join(labels, "node", "left").select("cls", "doc", F.coalesce("component", "node").alias("comp")))


def _named_components(docs: DataFrame, words: int, percent: int, rounds: int) -> DataFrame:
    """(doc, n_shingles, component) per row of ``docs``; null ids stay null."""
    rows, classes = _labelled(docs.select("doc_id", F.lit(None).cast("struct<file:long,row:long>").alias("key"), "text"), words, percent, rounds)
    # rows that repeat a doc_id with different texts tie their components together
    held = rows.where("doc is not null and cls is not null").join(classes.select("cls", "comp"), "cls").select("doc", "comp")
    repeated = held.groupBy("doc").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    ties = held.distinct().join(repeated.select("doc", "_lo"), "doc").select(F.col("comp").alias("a"), F.col("_lo").alias("b"))
    tied = components(ties).select(F.col("node").alias("comp"), F.col("component").alias("_tied"))
    classes = classes.join(tied, "comp", "left").select("cls", "doc", F.coalesce("_tied", "comp").alias("comp"))
    names = classes.groupBy("comp").agg(F.min("doc").alias("component"))
    joined = rows.join(classes.join(names, "comp").select("cls", "component"), "cls", "left")
    return cut(joined.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component")))


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc, n_shingles, component) per row; doc is the id (NULL_ID for null, as for a component without ids)."""
    known = lambda c: F.coalesce(c, F.lit(NULL_ID)).alias(c)
    return _named_components(docs, words, percent, rounds).select(known("doc"), "n_shingles", known("component"))


def _may_reach(na, pa, nb, pb, percent: int):
    """Whether sets that share a token at these positions can still be similar enough.

    At most the tokens up to the nearer position and those after the later one are shared.
    """
    most = F.least(pa, pb) + F.least(na - pa, nb - pb)
    return 100 * most >= percent * (na + nb - most)


def _may_agree(percent: int):
    """Whether sets a and b can be similar enough by their own tokens and parity bits (see ``parity_bits``)."""
    differ = reduce(add, [F.bit_count(F.col(f"a{g}").bitwiseXOR(F.col(f"b{g}"))) for g in PARITY])
    return (F.col("oa") + F.col("ob") + differ) * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))


def _enough(classes: DataFrame, percent: int) -> DataFrame:
    """Without the classes whose k shared prefix tokens are too few for any partner.

    A partner of a set of n tokens has at least ``percent`` of n tokens and so asks for
    at least ``fewest_matches`` of that many.
    """
    least = F.ceil(F.col("n") * percent / 100)
    fewest = F.least(F.lit(FEWEST_MOST), F.greatest(F.lit(1), F.floor(least / FEWEST_PER)))
    return classes.where(F.col("k") >= fewest)


def _led_pairs(posts: DataFrame, salt: int, percent: int) -> DataFrame:
    """Each node with the leaders (of other components) that it shares most lists with."""
    rank = lambda j: F.min(F.struct(F.xxhash64("node", F.lit(salt * LEADERS + j)), F.col("node"), F.col("comp"), F.col("n"), F.col("pos")))
    leaders = posts.groupBy("token").agg(*[rank(j).alias(f"_{j}") for j in range(LEADERS)])
    leaders = leaders.select("token", F.array_distinct(F.array(*[F.col(f"_{j}") for j in range(LEADERS)])).alias("leads"))
    near = F.filter("leads", lambda x: (x["comp"] != F.col("comp")) & _may_reach(x["n"], x["pos"], F.col("n"), F.col("pos"), percent))
    led = posts.join(leaders, "token").select("node", F.explode(near).alias("lead")).select("node", F.col("lead.node").alias("b"))
    shared = led.groupBy("node", "b").agg(F.count(F.lit(1)).alias("c")).join(posts.groupBy("node").agg(F.count(F.lit(1)).alias("lists")), "node")
    # a node meets at most LEADERS nodes per list of its own prefix
    fair = shared.where(F.col("c") * FAIR >= F.col("lists"))
    best = fair.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, TRIED).alias("x"))
    return best.select(F.col("node").alias("a"), F.explode("x").alias("x")).select("a", F.col("x.b").alias("b"))


def _all_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a prefix token and can still be similar enough.

    A pair is wanted at its first shared token, where at most that token and those after
    it are shared. It is left out at a token that has another shared one just before it
    in both sets: so near copies, which meet in most of their lists, leave the join about
    once, and pairs whose own tokens or parity bits differ too much not at all.
    """
    names = [("node", ""), ("n", "n"), ("own", "o"), ("comp", "c"), ("pos", "p"), ("before", "w")]
    side = lambda x: posts.select("token", *[F.col(c).alias(n + x) for c, n in names], *[F.col(g).alias(x + g) for g in PARITY])
    most = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    able = (100 * most >= percent * (F.col("na") + F.col("nb") - most)) & _may_agree(percent)
    met = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & able & ~F.arrays_overlap("wa", "wb"))
    return met.select("a", "b").distinct()


def q_jaccard_join(spark, sf_dir):
    found = _named_components(table(spark, sf_dir, "documents"), WORDS, PERCENT, ROUNDS)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one_per_component(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (a stored table) with one row for each component of similar texts.

    That is the row of its smallest doc_id (null last), of several the one with the
    smallest row key. Rows without a shingle link with nothing and all stay.
    """
    names = docs.columns
    rows, classes = _labelled(docs.select("doc_id", file_row().alias("key"), "text"), words, percent, rounds)
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "key"))
    per_class = rows.where("cls is not null").groupBy("cls").agg(first.alias("_first"))
    per_comp = per_class.join(classes.select("cls", "comp"), "cls").groupBy("comp").agg(F.min("_first").alias("_first"))
    kept = per_comp.select(F.col("_first.key").alias("_kept")).unionByName(rows.where("cls is null").select(F.col("key").alias("_kept")))
    keyed = docs.withColumn("_doc_row", file_row())
    return keyed.join(kept.hint("shuffle_hash"), F.col("_doc_row") == F.col("_kept")).select(*[F.col(f"`{c}`") for c in names])
