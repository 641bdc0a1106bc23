"""WebVTT documents and cue text."""

import pytest
from pyspark.sql import functions as F

from cueframe.functions import vtt_text
from cueframe.operators.vtt import parse_vtt

T = "00:01.000 --> 00:02.000"
CASES = [
    ("", [("error", "MissingSignature")]),
    ("WEBVTTx", [("error", "InvalidSignature")]),
    ("WEBVTT", []),
    (f"﻿WEBVTT text\nmore\n{T}\na\n", [("cue", None, "a")]),
    (f"WEBVTT\n\nid\n{T}\na\n{T}\nb\n", [("cue", "id", "a"), ("cue", None, "b")]),
    (f"WEBVTT\n\nx\nid\n{T}\na\n", [("cue", "id", "a")]),
    (f"WEBVTT\n\nNOTE {T}\nrest\n\n{T}\nx\n", [("note", None, f"{T}\nrest"), ("cue", None, "x")]),
    (f"WEBVTT\n\nid\nNOTE\nin\n{T}\n\n", [("note", None, f"in\n{T}")]),
    (f"WEBVTT\n\n00:61.000 --> x\nlost\n{T}\nx\n", [("cue", None, "x")]),
    (f"WEBVTT\n\nSTYLE\na\n\n{T}\n\nSTYLE\nb\n", [("style", None, "a"), ("cue", None, "")]),
    (f"WEBVTT\n\nSTYLE --> x\n{T}\n", [("style", None, f"{T}")]),
    (f"WEBVTT\n\n{T}\na\n﻿\nb\r\nc", [("cue", None, "a\n﻿\nb\r\nc")]),
]


@pytest.mark.parametrize("content,want", CASES)
def test_blocks(spark, content, want):
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    got = parse_vtt(docs).orderBy("ordinal").collect()
    assert [("error", r["error"]) if r["error"] else (r["block_type"], r["identifier"], r["body"]) for r in got] == want


def dumped(spark, body, depth=16):
    return spark.createDataFrame([(body,)], "b string").select(vtt_text.dump(vtt_text.tree(F.col("b"), depth)["nodes"]).alias("d")).collect()[0]["d"]


@pytest.mark.parametrize(
    "body,want",
    [
        ("a<b>c", '| "a"\n| <b>\n|   "c"'),
        ("<ruby>x<rt>y</ruby>z", '| <ruby>\n|   "x"\n|   <rt>\n|     "y"\n| "z"'),
        ("<rt>y</rt>", '| "y"'),
        ("<v.a.b  A&amp;B >x</c></v>y", '| <span>\n|   class="a b"\n|   title="A&B"\n|   "x"\n| "y"'),
        ("<00:01.500>x<bogus>y", '| <?timestamp 00:00:01.500>\n| "x"\n| "y"'),
        ("x<i", '| "x"\n| <i>'),
    ],
)
def test_trees(spark, body, want):
    assert dumped(spark, body) == want


def test_depth(spark):
    assert dumped(spark, "<b><i><u>x</u>y</i>z", 2) == '| <b>\n|   <i>\n|     "x"\n|     "y"\n|   "z"'


def test_serialized_tree_reads_back(spark):
    body = "<b.x>a<i>c</i></b><lang en>d<00:01.000>e</lang>"
    got = spark.createDataFrame([(body,)], "b string").select(vtt_text.serialize(vtt_text.tree(F.col("b"))["nodes"]).alias("s")).collect()[0]["s"]
    assert got == body


@pytest.mark.parametrize(
    "text,want",
    [("&notit;", "\xacit;"), ("&amp;lt;", "&lt;"), ("&#X", "&#x"), ("&#38", "&"), ("&#x110000;", "�"), ("&#x8D;", "\x8d"), ("&#x80", "€"), ("a\0b", "a�b"), ("& &x;", "& &x;"), ("&nGt;", "≫⃒")],
)
def test_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(vtt_text.decode_references(F.col("t")).alias("d")).collect()[0]["d"] == want
