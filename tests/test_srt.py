"""SubRip documents and bodies."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cueframe.functions import srt_text
from cueframe.operators.srt import parse_srt, write_srt
from cueframe.plans.options import SrtOptions

T = "00:00:01,000 --> 00:00:02,500"


def rows(spark, content, options=SrtOptions()):
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    return [(r["index"] and int(r["index"]), r["body"], r["error"]) for r in parse_srt(docs, options).orderBy("ordinal").collect()]


STRICT = [
    ("", []),
    (f"1\n{T}\na\nb\n\n2\n{T}\nc", [(1, "a\nb", None), (2, "c", None)]),
    (f"﻿1\r\n{T} X1:5\r\na\r\nb\r\n", [(1, "a\r\nb", None)]),
    (f"1\n{T}\n\n", [(1, "", None)]),
    (f"1\n{T}\n \n\n", [(1, " ", None)]),
    (f"1\n{T}\na\n\n1\n{T}\n", [(1, "a", None), (None, None, "NonMonotonicIndex")]),
    (f"x\n1\n{T}\n", [(None, None, "Unknown")]),
    ("7\n", [(None, None, "ExpectedHeader")]),
    ("7\n8\n", [(None, None, "ExpectedHeader")]),
    (f"0\n{T}\n", [(None, None, "ParseIndex.Zero")]),
    (f"18446744073709551616\n{T}\n", [(None, None, "ParseIndex.ParseInt")]),
    (f"{'9' * 21}\n{T}\n", [(None, None, "ParseIndex.Overflow")]),
    (f"18446744073709551615\n{T}\nx", [(18446744073709551615, "x", None)]),
]
LOSSY = [
    (f"stray\n{T}\na\n\n9\nbad\nlost\n\n3\n{T}\nb\n", [(None, "a", None), (3, "b", None)]),
    (f"24 hours later\n{T}\na\n", [(24, "a", None)]),
    ("1\n00:00:01.000 --> 00:00:02.000\nx\n", []),
]


@pytest.mark.parametrize("content,want", STRICT)
def test_strict(spark, content, want):
    assert rows(spark, content) == want


@pytest.mark.parametrize("content,want", LOSSY)
def test_lossy(spark, content, want):
    assert rows(spark, content, SrtOptions.lossy()) == want


def test_null_and_repeated_contents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f"1\n{T}\nx")], "doc_id int, content string")
    assert [r["doc_id"] for r in parse_srt(docs).collect()] == [3]


def test_round_trip(spark):
    content = f"1\n{T}\na\nb\n\n2\n100:00:01,000 --> 999:59:59,999\n\n\n3\n{T}\nc\n"
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    assert write_srt(parse_srt(docs)).collect()[0]["content"] == content


def clean(body):
    """A reading of the token rules by hand."""
    out, i = "", 0
    tag = re.compile(r"</?(?:[biusBIUS]|[fF][oO][nN][tT])(?:>|[ \t][^<>]*>)")
    br = re.compile(r"</?[bB][rR](?:/?>|[ \t][^<>]*>)")
    code = re.compile(r"\{\\[^{}]*\}|\{[CcFfoPSsYy]:[^{}]*\}")
    while i < len(body):
        if m := br.match(body, i):
            out += "\n"
        elif not (m := tag.match(body, i) or code.match(body, i)):
            out += body[i]
            i += 1
            continue
        i = m.end()
    return out


def test_plain_text_against_a_hand_reading(spark):
    rng = random.Random(1)
    parts = ["<", ">", "b", "</i>", "<br", "<br/>", "<font color=x>", "{", "}", "\\an8", "{\\i1}", "{y:i}", " ", "\n", "é", "/", "<b <br>>", "&amp;"]
    bodies = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", srt_text.plain_text(F.col("b")).alias("p")).collect()
    assert all(r["p"] == clean(r["b"]) for r in got)


def test_attributes(spark):
    text = "color=\"red\" size=3 bold face='a b"
    got = spark.createDataFrame([(text,)], "a string").select(srt_text.attributes(F.col("a")).alias("x")).collect()[0]["x"]
    assert [(a["name"], a["value"]) for a in got] == [("color", "red"), ("size", "3"), ("bold", None), ("face", "a b")]
