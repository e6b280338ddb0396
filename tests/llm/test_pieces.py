"""Distinct-word SentencePiece encoding against the library on whole texts."""

from __future__ import annotations

import random

import pytest
import sentencepiece

from gleaner.llm import pieces as X
from gleaner.llm.common import importable


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=X.model_file())


def expected(library, rows):
    return sorted(((-1 if d is None else d), tuple(ids := library.encode(t or "")), library.decode(ids)) for d, t in rows)


def coded(df, **kw):
    out = X.decode_documents(X.encode_documents(df, X.model_file(), **kw), X.model_file()).collect()
    return sorted(((-1 if r.doc_id is None else r.doc_id), tuple(r.ids), r.text) for r in out)


def test_words_are_segmented_as_in_their_text(library):
    rng = random.Random(8)
    signs = [*"ab cé ▁ \n\r\t\x00\x01\x0b日本🙂.,;(){}' 　‍�\x1c\x1d", "the ", "ing", "  ", "▁x", "<s>", "</s>", "<0x0A>", "<unk>", " \n", "\r\n"]
    tool = X.segmenter(X.model_file())
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 50)))
        assert [i for ids in tool.segment(tool.cut(text)) for i in ids] == library.encode(text)


def test_ids_and_texts_equal_the_library(spark, library):
    importable(spark)
    rng = random.Random(9)
    texts = [None, "", " ", "▁", "\n \n", "x" * 20_000, "日本語" * 4000]
    texts += [" ".join(rng.choice(["the", "tokens", "of", "Zürich", "▁▁", "a\nb", str(rng.random())]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = [(None if i % 50 == 49 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # blocks of a few documents and one block per partition give the same
    assert coded(df, block_chars=500) == expected(library, rows)
    assert coded(df) == expected(library, rows)


def test_edge_rows(edge_docs, no_docs, library):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert coded(edge_docs) == expected(library, rows)
    assert coded(no_docs) == []


def test_a_word_is_segmented_once(monkeypatch):
    """Inside a block every word has one number, new ones in order of their first occurrence."""
    block = X.Block()
    block.add(1, ["▁a", "▁b", "▁a"], 5)
    block.add(2, ["▁b", "▁c"], 3)
    assert list(block.number) == ["▁a", "▁b", "▁c"]
    assert [n.tolist() for n in block.parts[0][2]] == [[0, 0, 1], [2, 0]]


def test_models_whose_pieces_cross_a_marker_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

        def is_control(self, i):
            return False

        is_byte = is_unknown = is_control

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        X.Segmenter("any")
