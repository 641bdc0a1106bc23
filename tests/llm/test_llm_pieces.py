"""Encoding and decoding agree with the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cueframe.llm import pieces
from cueframe.llm.entry import op11_sentencepiece, pieces_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces_path())


@pytest.fixture(scope="module")
def known():
    return pieces.model(pieces_path())


def ids_of(known, *texts):
    return [np.frombuffer(packed, dtype="<i4").tolist() for packed in known.encode(list(texts))]


TEXT = st.text(st.one_of(st.sampled_from(list("athein  \t\n\r▁▁é́あ執벨😀ﬁ0123.,'<>\x00")), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_any_texts(library, known, texts):
    for text, ids in zip(texts, ids_of(known, *texts), strict=True):
        assert ids == library.encode(text)
        assert known.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31999), st.sampled_from([28705, 259, 260])), max_size=12))
def test_any_ids(library, known, ids):
    assert known.decode(ids) == library.decode(ids)


def test_pieces_that_wait(library, known):
    """Words of repeated syllables, where the next occurrence of a pair has to wait for a neighbour; runs of marks, whose pieces share a rank."""
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice(["the", "ing", "ion", "in", "a", "e", "t", "h", "nn", "▁", " ", "  "]) for _ in range(rnd.randint(1, 40)))
        assert ids_of(known, text) == [library.encode(text)]


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "thein" * 2000, "\n" * 300, "執あ" * 700 + "😀" * 300, "".join(map(chr, range(0x21, 0x3000)))])
def test_long_words(library, known, text):
    """Beyond ``LONGEST`` a heap merges the same."""
    assert ids_of(known, text) == [library.encode(text)]


def test_rounds_and_heap_agree(known):
    rnd = random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("theinga▁é ") for _ in range(rnd.randint(2, 60)))
        points = np.array([ord(c) for c in word])
        symbol = known.chars[points]
        out, seen = np.where(symbol < len(known.pieces), symbol, -1), np.ones(len(word), dtype=bool)
        known._merge_long(symbol, out, seen)
        assert known._packed(points, out, seen, np.array([len(word)])) == known.merge([word])


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(spark, library):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "don't", 9), (None, "don't", 9)], "doc_id long, text string, _text int")
    rows = pieces.encode(docs, pieces_path(), decoded_col="text").collect()
    assert [list(r["ids"]) for r in rows] == [[], [], *[library.encode("don't")] * 2]
    assert [r["text"] for r in rows] == ["", "", "don't", "don't"] and {r["_text"] for r in rows} == {9}
    assert pieces.decode(pieces.encode(docs.limit(0), pieces_path()), pieces_path()).count() == 0
    ids = spark.createDataFrame([(None,), ([],), ([231, 1, 185, 143],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode(ids, pieces_path()).collect()] == [None, "", library.decode([231, 1, 185, 143])]
