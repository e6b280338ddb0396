"""SentencePiece encoding and decoding through a table of distinct marked words.

A normalised text marks every blank as U+2581. When no piece of the model crosses from
another character into a marker, no merge does either, so the text may be cut before
every run of markers and each part segmented by itself with the same result. (It is
also cut around line feeds, if no longer piece holds one.) Each distinct part, a marked
word, is segmented once:

1. Where the texts are read, the words of a block of documents (about ``BLOCK_CHARS``
   characters) are numbered as they first occur. A document becomes its word numbers;
   the block's word list is split by word hash into packets.
2. Packets meet by word hash: every distinct word of the corpus is in one task, which
   segments it once and sends its ids back to the blocks that hold it. A word occurs at
   most once per block here, so no frequent word makes a hot task.
3. Every block joins the ids to its word numbers by position.

It is one chain of two shuffles without a second scan, so a stage that is run again
after a lost executor sees the same blocks. Word numbers travel as compressed byte
planes (a word's first occurrence is just 0), about a third of the size of the texts.
Memory holds one block, or the distinct words of one packet number.

``decode`` is the library's own decoding of each row's ids.

Cases: null text is encoded like an empty one, to no ids; repeated rows and repeated or
null doc_ids stay rows of their own; a text without blanks is one word however long it
is; a very long text is a block of its own; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import shuffle_width, table, worker_keeps

MARK = "▁"
BLOCK_CHARS = 32_000_000
PART_CHARS = 2_000_000
#: characters tried as a barrier: one that no piece of several characters holds
BARRIERS = "\n\x1d\x1e\x1f"


class Segmenter:
    """The library's processor with what the cut into words needs: the word pattern and a barrier."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]
        crossing = [x for x in pieces if re.search(f"[^{MARK}]{MARK}", x)]
        if crossing:
            raise ValueError(f"pieces such as {crossing[0]!r} cross a whitespace marker: words cannot be segmented one by one")
        probe = " ﬁ  Ａéé "
        if p.decode(p.encode(probe)) != probe:
            raise ValueError("the model normalises texts by more than marking blanks")
        inside = set("".join(x for x in pieces if len(x) > 1))
        barriers = [c for c in BARRIERS if c not in inside]
        if not barriers:
            raise ValueError("no barrier character: every one tried is part of a longer piece")
        self.barrier = barriers[0]
        lone = "\n" if "\n" not in inside else ""
        self.words = re.compile(f"[ {MARK}]*[^ {MARK}{lone}]+|[ {MARK}]+" + (f"|{lone}" if lone else "")).findall
        self.head = len(p.encode(self.barrier))

    def cut(self, text: str | None) -> list[str]:
        """The marked words of a text, which joined make the normalised text (a blank is as good as a marker)."""
        return self.words(" " + text) if text else []

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word as it stands inside a text (behind a barrier, whose ids are dropped)."""
        head = self.head
        return [ids[head:] for ids in self.processor.encode([self.barrier + w for w in words], num_threads=1)]


def segmenter(path: str) -> Segmenter:
    return worker_keeps(f"pieces of {path}", lambda: Segmenter(path))


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


#: block, place (packet number, or past them for documents), kind (0 words, 1 ids of words, 2 documents), part of the
#: block, and what the kind needs: positions of the words in the block, the words or their ids, document ids and sizes
PACKETS = "block long, place int, kind int, part int, n long, positions binary, sizes binary, body binary, doc_ids array<long>"
_PACKETS = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("positions", pa.binary()), ("sizes", pa.binary()),
    ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
])


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKETS.types)], schema=_PACKETS)


class Numbers(dict):
    """Numbers words from 1 in order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """Words of a block numbered by first occurrence, and its documents as numbers (0: the next new word)."""

    def __init__(self):
        self.number = Numbers()
        self.parts: list[tuple[list, list, list]] = []
        self.chars = self.part_chars = self.seen = 0

    def add(self, doc_id, words: list[str], chars: int) -> None:
        if not self.parts or self.part_chars > PART_CHARS:
            self.parts.append(([], [], []))
            self.part_chars = 0
        ids, sizes, numbers = self.parts[-1]
        new = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        if len(self.number) > self.seen:
            # a number above all before it is that word's first
            highest = np.maximum.accumulate(np.concatenate([[self.seen], new]))
            new[new > highest[:-1]] = 0
            self.seen = len(self.number)
        ids.append(doc_id)
        sizes.append(len(words))
        numbers.append(new)
        self.chars += chars
        self.part_chars += chars

    def rows(self, block: int, packets: int) -> Iterator[tuple]:
        coded = [w.encode() for w in self.number]
        place = np.fromiter((zlib.crc32(w) % packets for w in coded), np.int64, len(coded))
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(packets), side="right")
        start = 0
        for k, end in enumerate(ends.tolist()):
            if end > start:
                mine = order[start:end]
                texts = [coded[i] for i in mine.tolist()]
                sizes = pack(np.fromiter(map(len, texts), np.uint32, len(texts)))
                yield block, k, 0, 0, len(mine), pack(np.diff(mine, prepend=0)), sizes, pa.compress(b"".join(texts), codec="zstd", asbytes=True), None
            start = end
        for k, (ids, sizes, numbers) in enumerate(self.parts):
            flat = np.concatenate(numbers)
            yield block, packets + (block + k) % packets, 2, k, len(flat), None, pack(np.array(sizes, np.uint32)), pack(flat), ids


def _words_of(row: dict) -> list[str]:
    ends = np.cumsum(unpack(row["sizes"], row["n"]).astype(np.int64)).tolist()
    body = pa.decompress(row["body"], decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [body[a:b].decode() for a, b in zip([0, *ends], ends)]


def encode_documents(docs: DataFrame, model_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and the ids of its whole text: (doc_id long, ids array<int>)."""
    packets = 4 * shuffle_width(docs.sparkSession)

    def number(batches):
        cut, base = segmenter(model_path).cut, TaskContext.get().partitionId() << 33
        block, made = Block(), 0

        def closed():
            rows = list(block.rows(base + made, packets))
            yield from (_batches(rows[i : i + 16]) for i in range(0, len(rows), 16))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    block.add(doc_id, cut(text), len(text or ""))
                    if block.chars >= block_chars:
                        yield from closed()
                        block, made = Block(), made + 1
        if block.parts:
            yield from closed()

    def segment(batches):
        tool, at, known = segmenter(model_path), None, {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if row["place"] != at:  # rows come sorted by place: the words of other places are elsewhere
                        at, known = row["place"], {}
                    words = _words_of(row)
                    fresh = [w for w in words if w not in known]
                    known.update(zip(fresh, (array("I", x).tobytes() for x in tool.segment(fresh))))
                    ids = list(map(known.__getitem__, words))
                    row["sizes"] = pack(np.fromiter(map(len, ids), np.uint32, len(ids)) >> 2)
                    row["body"] = pack(np.frombuffer(b"".join(ids), np.uint32))
                    row["kind"] = 1
                rows.append(tuple(row[n] for n in _PACKETS.names))
            if rows:
                yield _batches(rows)

    def join(group: pa.Table) -> pa.Table:
        """The documents of one block: ids of its words, placed by position."""
        sides: dict[int, list[dict]] = {1: [], 2: []}
        for row in group.to_pylist():
            sides[row["kind"]].append(row)
        at = [np.cumsum(unpack(r["positions"], r["n"]).astype(np.int64)) for r in sides[1]]
        size = [unpack(r["sizes"], r["n"]).astype(np.int64) for r in sides[1]]
        flat = [unpack(r["body"], int(s.sum())) for r, s in zip(sides[1], size)]
        lengths = np.zeros(sum(map(len, at)), np.int64)
        starts = lengths.copy()
        offset = 0
        for a, s in zip(at, size):
            lengths[a] = s
            starts[a] = offset + np.cumsum(s) - s
            offset += int(s.sum())
        ids = np.concatenate([*flat, np.zeros(0, np.uint32)])
        doc_ids, lists, seen = [], [], 0
        for r in sorted(sides[2], key=lambda r: r["part"]):
            numbers = unpack(r["body"], r["n"]).astype(np.int64)
            new = numbers == 0
            word = np.where(new, seen + np.cumsum(new) - 1, numbers - 1)
            seen += int(new.sum())
            n = lengths[word]
            ends = np.cumsum(n)
            pick = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[word] - ends + n, n)
            texts = np.concatenate([[0], np.cumsum(unpack(r["sizes"], len(r["doc_ids"])).astype(np.int64))])
            bounds = np.concatenate([[0], ends])[texts]
            lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[pick].astype(np.int32))))
            doc_ids += r["doc_ids"]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})

    numbered = docs.select("doc_id", "text").mapInArrow(number, PACKETS)
    segmented = numbered.repartition(shuffle_width(docs.sparkSession), "place").sortWithinPartitions("place").mapInArrow(segment, PACKETS)
    return segmented.groupBy("block").applyInArrow(join, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with the text that their ids decode to: (doc_id long, ids array<int>, text string)."""

    def run(batches):
        tool = segmenter(model_path).processor
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column("ids")
                ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                texts = [tool.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                yield part.append_column("text", pa.array(texts, pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def q_pieces(spark, sf_dir):
    path = model_file()
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
