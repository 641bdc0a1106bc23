"""Encoding agrees with the tiktoken library; decoding gives the bytes back."""

import base64
import contextlib
import hashlib
import io
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueframe.llm import bpe
from cueframe.llm.entry import op3_byte_bpe, ranks_path

#: The same pattern for the regex library, whose own white space class holds four controls more.
SLOW = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(ranks_path())


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


TEXT = st.text(st.one_of(st.sampled_from(list("abzé'stmdrevl  \t\n\r\x0b 　  0九٣!?#😀́")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_any_texts(library, words, texts):
    for text, (ids, offsets) in zip(texts, words.encode(texts), strict=True):
        assert ids == packed(library.encode_ordinary(text))
        assert words.decode(ids) == words.decode(ids, offsets) == text.encode()
        assert offsets[:, 0].tolist() == sorted(set(offsets[:, 0].tolist())) and offsets[:, 1].tolist() == sorted(set(offsets[:, 1].tolist()))
        # What is assigned since this Python's Unicode data, the regex library may class by a later version than the other.
        if not any(unicodedata.category(c) == "Cn" for c in text):
            assert offsets[:, 0].tolist() == [m.start() for m in regex.finditer(SLOW, text)]
        for a in range(0, len(text), 3):
            assert words.decode_span(ids, offsets, a, a + 5) == text[a : a + 5]


def test_new_letters(library, words):
    """Every code point is classed as the library classes it."""
    text = "".join("a" + chr(c) + "1" for c in range(0x80, 0x32000, 7) if not 0xD800 <= c < 0xE000)
    ((ids, offsets),) = words.encode([text])
    assert ids == packed(library.encode_ordinary(text)) and words.decode(ids, offsets) == text.encode()


def test_offsets_that_do_not_fit(words):
    ((ids, offsets),) = words.encode(["some words, and others"])
    assert words.decode(ids[4:], offsets) is None and words.decode(ids, offsets[1:]) is None and words.decode(ids[:-4], offsets) is None
    assert words.decode(b"\xff\xff\xff\x7f" + ids[4:], offsets) is None


def test_long_pieces(library, words):
    for text in ("a" * 5000, " " * 5000 + "x", "ab" * 3000 + "!" * 3000, "\n" * 200, "it's we'll 'tis '' 'rex I'd"):
        ((ids, _),) = words.encode([text])
        assert ids == packed(library.encode_ordinary(text))


def test_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert re.fullmatch("[0-9a-f]{64}", r["ids_sha256"])


def test_edges(spark, library):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "don't", 9), (None, "don't", 9)], "doc_id long, text string, _bpe int")
    rows = bpe.encode(docs, ranks_path(), offsets_col="at").collect()
    assert [bytes(r["ids"]) for r in rows] == [b"", b"", *[packed(library.encode_ordinary("don't"))] * 2]
    assert [np.frombuffer(r["at"], dtype="<i4").reshape(-1, 2)[:, 0].tolist() for r in rows] == [[], [], [0, 3], [0, 3]]
    assert {r["_bpe"] for r in rows} == {9}
    assert bpe.decode(bpe.encode(docs.limit(0), ranks_path()), ranks_path()).count() == 0


def test_spans_and_damage(spark):
    texts = ["don't say  it twice", "é 😀 ok", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encode(docs, ranks_path(), offsets_col="offsets")
    got = bpe.decode_span(rows, ranks_path(), F.lit(2), F.lit(7)).orderBy("doc_id").collect()
    assert [r["span"] for r in got] == [(t or "")[2:7] for t in texts]
    both = bpe.encode(docs, ranks_path(), offsets_col="offsets", decoded_col="text").orderBy("doc_id").collect()
    assert [bytes(r["text"]).decode() for r in both] == [t or "" for t in texts]
    cut = rows.withColumn("ids", F.expr("substring(ids, 5)"))
    assert [r["decoded"] for r in bpe.decode(cut, ranks_path(), offsets_col="offsets").orderBy("doc_id").collect()] == [None, None, b"", b""]


def test_encoded_once(spark):
    """The encoder stands once in the plan, though ids, offsets and decoded bytes are read."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        op3_byte_bpe(spark, SF).explain()
    assert out.getvalue().count("MapInArrow") == 1 and "EvalPython" not in out.getvalue()
