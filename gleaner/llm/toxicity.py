"""Toxicity scores over text that a noisy-channel decoder has restored.

A character trigram model is counted over every document. Words that look disguised
(letters mixed with digits or signs, runs of one letter, single letters set apart by
blanks or signs) become lattices: every observed character may stand for the letters
it imitates, may be noise, or may repeat the letter before it. A Viterbi search under
the character model restores the likeliest spelling; plain words have one path and
pass unchanged.

A lexicon is learned from labelled documents: restored words and their beginnings,
folded to plain letters with runs collapsed, whose share of toxic documents lies above
the base rate beyond chance (a Chernoff bound with a Bonferroni margin). A document's
score is the noisy-or of its words' shares. Only text enters a score.

Bounds: the labelled sample holds at most ``max_labelled`` rows (those with the smallest
hash of their id; exact copies count once), the lexicon at most ``max_features`` entries,
the character model 27^3 counts. Counting and scoring cover all documents whole.

Cases: null, empty and blank texts get the base score; without labels (or without
toxic ones) every text does; labels that repeat a doc_id count as toxic if any row
says so; null labels are ignored; repeated rows are scored alike; an empty table gives
an empty result; extra columns are carried along by ``reject_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table, worker_lets_go

N = 27  # 0: anything between words, 1-26: letters
MAX_LABELLED = 16_000
MAX_FEATURES = 4096
THRESHOLD = 0.3
_CACHE = 200_000
_LISTS_CACHE = 100_000  # where a token's features are remembered, some 500 bytes each
_COUNTED = 200_000  # features that a task counts before it passes the counts on
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: letters that a sign commonly imitates
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "µ": "u",
}
_EDGE = ".,;:?!\"'()[]{}<>«»“”„‘’…¿¡-–—_/\\&%#*=~^`"
_SOFT_EDGE = ".,;:?\"'[]{}<>«»“”„‘’…¿¡"
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][^\w\n]{1,2}|[^\W_]_){3,}[^\W_](?![^\W_])")
_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1\1")
_SIGN_TAIL = re.compile(r"([^\w\s])\1{2,}$")
_JOINTS = str.maketrans("", "", "'’-­")


def _folding() -> tuple[dict[int, str], np.ndarray]:
    """Letters below U+0250 folded to a-z: a translation for strings, a class per code point."""
    fold, classes = {}, np.zeros(0x250, np.uint8)
    for code in range(0x250):
        plain = [c for c in unicodedata.normalize("NFKD", chr(code).lower()) if c in _LETTERS]
        plain = "".join(plain) or {"ß": "ss", "æ": "ae", "ø": "o", "œ": "oe", "ł": "l", "đ": "d"}.get(chr(code).lower(), "")
        if chr(code).isalpha() and plain:
            fold[code] = plain
            classes[code] = _LETTERS.index(plain[0]) + 1
    return fold, classes


FOLD, CLASSES = _folding()


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of folded character trigrams, one small batch per partition."""
    worker_lets_go()
    total = np.zeros(N**3, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
            c = CLASSES[np.where(codes < len(CLASSES), codes, 0)].astype(np.int32)
            total += np.bincount(c[:-2] * (N * N) + c[1:-1] * N + c[2:], minlength=N**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) with bigram and unigram smoothing; at most 27^3 counts reach the driver."""
    rows = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(N**3)
    for code, count in rows:
        n[code] = count
    n = n.reshape(N, N, N)
    tri = n / np.maximum(n.sum(2, keepdims=True), 1)
    bi = n.sum(0) / np.maximum(n.sum(0).sum(1, keepdims=True), 1)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + N)
    return np.log(0.85 * tri + 0.14 * bi[None] + 0.01 * uni)


class Decoder:
    """Restores words; the lattice search keeps every (last two letters) state."""

    SAME, NOISE, REPEAT = math.log(0.97), math.log(0.001), math.log(0.25)

    def __init__(self, model: np.ndarray):
        self.lm = model.tolist()
        look = math.log(0.9)
        self.readings: dict[str, list[tuple[int, float]]] = {c: [(i + 1, self.SAME)] for i, c in enumerate(_LETTERS)}
        for sign, letters in LOOKALIKES.items():
            self.readings[sign] = [(_LETTERS.index(c) + 1, look - math.log(len(letters))) for c in letters]
        self.readings["*"] = [(i + 1, math.log(0.3 / 26)) for i in range(26)]

    def viterbi(self, word: str) -> str:
        lm = self.lm
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for o in word:
            readings = self.readings.get(o, ())
            noise = None if o in _LETTERS else (self.NOISE if readings else -0.1)
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for c, cost in readings:
                    key, value = (b, c), score + cost + lm[a][b][c]
                    if key not in after or after[key][0] < value:
                        after[key] = (value, (path, c))
                    if c == b:
                        key, value = (a, b), score + cost + self.REPEAT
                        if key not in after or after[key][0] < value:
                            after[key] = (value, path)
                if noise is not None and ((a, b) not in after or after[a, b][0] < score + noise):
                    after[a, b] = (score + noise, path)
            states = after
        _, path = max(((s + lm[a][b][0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, c = path
            out.append(_LETTERS[c - 1])
        return "".join(reversed(out))

    def read(self, token: str) -> tuple[str, str]:
        """(plain word or '', restored letters or '') of a blank-separated, lower-cased token."""
        word = _SIGN_TAIL.sub("", token).strip(_EDGE)
        plain = word if word.isalpha() else word.translate(_JOINTS)
        if plain.isalpha():
            letters = plain.translate(FOLD)
            return plain, self.viterbi(letters) if _LONG_RUN.search(letters) else letters
        if not word or word.isdigit():
            return "", ""
        signs = _SIGN_TAIL.sub("", token).strip(_SOFT_EDGE).translate(FOLD)
        return "", self.viterbi(signs) if any(c in _LETTERS for c in signs) else ""

    def words(self, text: str | None) -> tuple[set[str], list[str]]:
        """(distinct tokens, restored words of letters that were set apart)."""
        if not text:
            return set(), []
        low = text.lower()
        apart = []
        for m in _APART.finditer(low):
            word = self.viterbi("".join(c for c in m.group().translate(FOLD) if not c.isspace() and c not in ".-_"))
            # such a run may hold several words: any of its letters may begin one
            apart += [word[i:] for i in range(max(1, len(word) - 3))]
        return set(low.split()), apart


def features(plain: str, restored: str) -> list[str]:
    """A restored word with runs collapsed and its beginnings; the plain word where that differs."""
    w = _RUN.sub(r"\1", restored)
    out = [w + "$", w[:4], w[:5]] if len(w) >= 5 else [w + "$", w] if len(w) == 4 else [w + "$"] if len(w) > 2 else []
    return out if plain == w or len(plain) < 4 else [*out, plain + "$", plain[:5], plain[:6]]


class _Cached:
    """A function of a token, remembered for a bounded number of tokens."""

    def __init__(self, f: Callable, most: int = _CACHE):
        self.f, self.most, self.known = f, most, {}

    def __call__(self, token: str):
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[token] = self.f(token)
        return got


def _feature_counts(model: np.ndarray):
    """Arrow batches (text, toxic) -> (feature, clean texts, toxic texts), a feature once or several times."""

    def run(batches):
        worker_lets_go()
        decoder = Decoder(model)
        known = _Cached(lambda t: features(*decoder.read(t)), _LISTS_CACHE)
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flushed(toxic: int):
            """One side's counts as columns, without a row object for each feature."""
            f = pa.array(seen[toxic].keys(), pa.string(), size=len(seen[toxic]))
            n = pa.array(seen[toxic].values(), pa.int64(), size=len(f))
            none = pa.array(np.zeros(len(f), np.int64))
            seen[toxic].clear()
            return pa.RecordBatch.from_arrays([f, none, n] if toxic else [f, n, none], names=["f", "clean", "toxic"])

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    tokens, apart = decoder.words(text)
                    found = {""}
                    for t in tokens:
                        found.update(known(t))
                    for w in apart:
                        found.update(features("", w))
                    seen[1 if toxic else 0].update(found)
                    if len(seen[0]) + len(seen[1]) > _COUNTED:
                        yield flushed(0)
                        yield flushed(1)
        yield flushed(0)
        yield flushed(1)

    return run


def lexicon(labelled: DataFrame, model: np.ndarray, max_features: int = MAX_FEATURES) -> tuple[dict[str, float], float]:
    """(feature -> share of toxic documents, base score) from (text, toxic) rows."""
    counts = labelled.mapInArrow(_feature_counts(model), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where("toxic >= 3 or f = ''").persist()
    try:
        all_ = counts.where("f = ''").first()
        if all_ is None or not all_["toxic"]:
            return {}, 0.01
        base = min(0.5, all_["toxic"] / (all_["clean"] + all_["toxic"]))
        n_features = counts.count()
        n, k = F.col("clean") + F.col("toxic"), F.col("toxic")
        share = k / n
        sure = share - F.sqrt(share * (1 - share) / n)  # one standard error below
        bound = n * (share * F.ln(share / base) + F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - base))).otherwise(0.0))
        strong = counts.where((F.col("f") != "") & (sure >= 0.8) & (bound > math.log(n_features + 1) + 4))
        rows = strong.select("f", (sure * (n / (n + 0.1))).alias("p"), bound.alias("b")).orderBy(F.desc("b"), "f").limit(max_features).collect()
    finally:
        counts.unpersist()
    return {r["f"]: r["p"] for r in rows}, min(0.1, base / 4)


def beginnings(shares: dict[str, float]) -> set[str]:
    """First three letters of the entries, also as they look with a letter doubled."""
    out = set()
    for f in shares:
        out |= {f[:3], f[0] * 2 + f[1:2], f[0] + f[1:2] * 2, f[:2] + "$"}
    return out


def score_texts(docs: DataFrame, model: np.ndarray, shares: dict[str, float], base: float):
    """A pandas UDF column function: text -> score."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model, shares, base))  # 27^3 floats and at most max_features entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_lets_go()
        model, shares, base = shared.value
        decoder = Decoder(model)
        best = lambda fs: max((shares.get(f, 0.0) for f in fs), default=0.0)
        known = _Cached(lambda t: best(features(*decoder.read(t))))
        starts = beginnings(shares)

        def one(text) -> float:
            clean = 1.0 - base
            tokens, apart = decoder.words(text)
            runs = bool(text) and _LONG_RUN.search(text.lower()) is not None
            for t in tokens:
                word = t if t.isalpha() else t.strip(_EDGE)
                if word.isalpha() and not runs:  # a plain word: only one that begins like an entry can be one
                    if not (word[:3] in starts or not word.isascii() and word[:4].translate(FOLD)[:3] in starts):
                        continue
                clean *= 1.0 - known(t)
            for w in apart:
                clean *= 1.0 - best(features("", w))
            return 1.0 - clean

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, dict[str, float], float]:
    """The character model of all documents and the lexicon of the labelled, not held-out ones."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # at most max_labelled rows of two numbers
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    labelled = labelled.select("text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"])
    model = character_model(docs)
    shares, base = lexicon(labelled.select("text", "toxic"), model)
    return model, shares, base


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = score_texts(docs, *train(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    score = score_texts(docs, *train(docs, labels))
    names = docs.columns
    return docs.withColumn("_toxicity", score(F.col("text"))).where(F.col("_toxicity") < threshold).select(*[F.col(f"`{c}`") for c in names])


def q_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
