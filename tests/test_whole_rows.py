"""Queries read every row of a table, however many a key has."""

import contextlib
import io

from pyspark.sql import functions as F

from cueframe.operators.ass import parse_ass
from cueframe.operators.srt import parse_srt
from cueframe.operators.vtt import parse_vtt
from cueframe.queries import vtt_roundtrip, vtt_tree_depth

SF = "/root/testdata/sf0.001"
SRT = "1\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:03,000 --> 00:00:04,000\nb\n"


def test_roundtrip_of_hot_user(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    names = [c for c in events.columns if c not in ("event_id", "user_id")]
    many = events.limit(1).crossJoin(spark.range(2000)).selectExpr("id as event_id", "user_id", *names).select(*events.columns)
    many.write.parquet(f"{tmp_path}/events.parquet")
    (row,) = vtt_roundtrip(spark, str(tmp_path)).collect()
    assert row["content"].count(" --> ") == 2000
    assert "01:06:40.000 --> 01:06:41.500" in row["content"] or "01:06:38.000 --> 01:06:39.500" in row["content"]


def test_tree_of_every_line(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        vtt_tree_depth(spark, SF).explain()
    assert "Join" not in out.getvalue() and "Aggregate" not in out.getvalue()


def test_parsing_shuffles_nothing(spark):
    """Documents are parsed where they are read, and rows of one id apart."""
    docs = spark.createDataFrame([(1, SRT), (1, SRT)], "doc_id int, content string")
    vtt = docs.withColumn("content", F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace("content", ",", ".")))
    ass = docs.withColumn("content", F.lit("[Events]\nFormat: Text\nDialogue: x\n"))
    for found, n in ((parse_srt(docs), 4), (parse_vtt(vtt), 4), (parse_ass(ass), 6)):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            found.explain()
        assert "Exchange" not in out.getvalue() and "Window" not in out.getvalue()
        assert found.count() == n and found.where("error is not null").count() == 0


def test_long_document(spark):
    """Time grows with the lines of a document."""
    content = "".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n{i}\n\n" for i in range(1, 40001))
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    assert parse_srt(docs).selectExpr("count(*)", "sum(index)", "max(ordinal)").first()[:] == (40000, 40000 * 40001 // 2, 39999)
