"""Sum-of-squares online packing of tokenised documents into fixed windows.

Documents arrive one after another within each input partition. The whole windows at
the front of a document are cut off as they are; its remainder goes to the fill level
that keeps the sum of squared counts of partially filled windows smallest, read from
a level array (``counts[h]`` open windows hold ``h`` tokens). That rule steers away
from levels where windows pile up, so matching fills stay available. When the stream
ends (or more than ``max_open`` windows are open) the open windows are settled: the
pieces of the emptiest are cut to fill the gaps of the fullest, which leaves at most
one window with padding per settlement.

Each partition packs for itself in one pass: memory holds one batch and the open
windows (at most ``max_open`` x ``window`` ids). Sequence numbers carry the partition
number in their upper bits. A partition that is computed again after a lost executor
reads the same file split and packs the same sequences.

Cases: null text is packed like an empty one (its end token only); repeated rows are
packed as often as they come; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gleaner.llm.common import table, worker_keeps

WINDOW = 4096
END_ID = 2
MAX_OPEN = 1024
_CACHE_WORDS = 500_000
#: str.split() also splits at these control characters, which the tokenizer takes as signs
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: letters whose lower case depends on their neighbours or is not a letter
_CONTEXT = regex.compile("[\u0130\u03a3]")
#: letters and the ASCII signs after them (no apostrophe: it may begin a contraction)
_TAIL = regex.compile(r"(\p{L}+)([!-&(-/:-@\[-`{-~]+)")
#: those signs, for words of ASCII only
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: the signs that stand for bytes in a byte-level vocabulary: printable bytes are themselves, others follow 255
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTABLE)}
_BLANK = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


class WordTokenizer:
    """Ids of whole texts for a tokenizer that never looks across white space.

    The new words of a text are encoded once and remembered (a bounded number of them);
    its ids are then looked up word by word. Words of letters only are one
    piece to the tokenizer, so they go to its model directly (composed, in lower case, as
    byte signs); all other words go through the whole tokenizer. Letters are
    first parted from signs that follow them, as the tokenizer does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit numbers
        self.long: list[str] = []
        self.bare: dict[str, bytes] = {}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if not word.isalpha():
                return self._encode(word)
            word = word.lower().encode().decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, words: set[str]) -> None:
        for word in words:
            letters, signs, ascii_only = word, "", word.isascii()
            if not word.isalpha():
                if ascii_only:
                    head = word.rstrip(_SIGNS)
                    if head.isalpha():
                        letters, signs = head, word[len(head) :]
                elif (parts := _TAIL.fullmatch(word)) and parts[1].isalpha() and not _CONTEXT.search(parts[1]):
                    letters, signs = parts.groups()
            if ascii_only:
                letters = letters.lower()
            ids = self.bare.get(letters)
            if ids is None:
                one_piece = letters.isalpha() and (ascii_only or not _CONTEXT.search(letters))
                ids = self.bare[letters] = array("I", self._letters(letters) if one_piece else self._encode(letters)).tobytes()
            if signs:
                tail = self.bare.get(signs)
                if tail is None:
                    tail = self.bare[signs] = array("I", self._encode(signs)).tobytes()
                ids += tail
            self.known[word] = ids
            if len(word) > 64:
                self.long += [word, letters, signs]

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        return [a.tolist() for a in self.arrays(texts)]

    def arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [_BLANK.split(t) if _SEPARATORS.search(t) else t.split() for t in (x or "" for x in texts)]
        for known in (self.known, self.bare):
            if len(known) > _CACHE_WORDS:
                known.clear()
        out = []
        for text in words:
            found = list(map(self.known.get, text))
            if new := {word for word, ids in zip(text, found) if ids is None}:
                self._learn(new)
                found = map(self.known.__getitem__, text)
            out.append(np.frombuffer(b"".join(found), np.uint32))
        for word in self.long:  # not worth remembering
            self.known.pop(word, None)
            self.bare.pop(word, None)
        self.long.clear()
        return out


def shared_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: later tasks of a worker find the words already known."""
    return worker_keeps(f"words of {path}", lambda: WordTokenizer(path))


class SumOfSquaresPacker:
    """Packs (doc, ids) pieces; ``done`` collects (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list]] = {}
        self.n_open = self.sequences = 0
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - n % w, w):
            self._close([(doc, start, ids[start : start + w], n)])
        if n % w:
            start = n - n % w
            self._place((doc, start, ids[start:], n))

    def _place(self, piece: tuple) -> None:
        w, counts, size = self.window, self.counts, len(piece[2])
        # change of the sum of squares by moving a window from level h to h + size, fullest first
        here, there = counts[1 : w - size][::-1], counts[1 + size : w][::-1]
        change = np.where(here > 0, 2 * (there - here + 1), np.iinfo(np.int64).max)
        best, level = 2 * counts[size] + 1, 0
        if len(change) and change[k := int(np.argmin(change))] < best:
            best, level = change[k], w - size - 1 - k
        if counts[w - size] and 1 - 2 * counts[w - size] <= best:
            level = w - size
        pieces: list = []
        if level:
            pieces = self.levels[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        self._keep(pieces, level + size)
        if self.n_open > self.max_open:
            self.settle(last=False)

    def _keep(self, pieces: list, fill: int) -> None:
        if fill == self.window:
            self._close(pieces)
            return
        self.levels.setdefault(fill, []).append(pieces)
        self.counts[fill] += 1
        self.n_open += 1

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1

    def settle(self, last: bool = True) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest."""
        rows = [(h, p) for h in sorted(self.levels, reverse=True) for p in self.levels[h]]
        self.levels, self.n_open = {}, 0
        self.counts[:] = 0
        i, j = 0, len(rows) - 1
        while i < j:
            fill, pieces = rows[i]
            gap = self.window - fill
            left, donor = rows[j]
            doc, start, ids, total = donor.pop()
            if len(ids) > gap:
                donor.append((doc, start, ids[:-gap], total))
                start, ids = start + len(ids) - gap, ids[-gap:]
            pieces.append((doc, start, ids, total))
            rows[j] = left - len(ids), donor
            rows[i] = fill + len(ids), pieces
            if rows[i][0] == self.window:
                self._close(pieces)
                i += 1
            if not donor:
                j -= 1
        if i == j and rows[i][1]:
            fill, pieces = rows[i]
            if last or fill == self.window:
                self._close(pieces)
            else:
                self._keep(pieces, fill)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: where it comes from, a checksum of its ids and where it went."""

    def run(batches):
        tokenizer = shared_tokenizer(tokenizer_path)
        packer = SumOfSquaresPacker(window, max_open)
        base = TaskContext.get().partitionId() << 33

        def emitted():
            rows = [
                (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + seq, offset)
                for doc, start, ids, total, seq, offset in packer.done
            ]
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], schema=_ARROW)

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer.arrays(part.column("text").to_pylist())):
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                yield emitted()
        packer.settle()
        yield emitted()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def q_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
