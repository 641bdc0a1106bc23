"""Files, views and streams."""

from pyspark.sql import functions as F

from cueframe.operators.srt import parse_srt
from cueframe.plans import views
from cueframe.sources.files import read_srt, write_documents
from cueframe.streaming.packets import clean_packets, event_packets, parse_stream, stream_documents

SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>hi</i>\n"


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    got = read_srt(spark, str(tmp_path)).collect()
    assert [r["body"] for r in got] == ["<i>hi</i>"]
    write_documents(spark.createDataFrame([("a", SRT)], "doc_id string, content string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out" / "doc_id=a").glob("*.txt")) == SRT


def test_views(spark):
    views.register(spark.createDataFrame([(1, SRT), (2, "x")], "doc_id int, content string"), "srt")
    assert spark.sql("select count(*) n from srt_entries").first()["n"] == 1
    assert spark.sql("select error from srt_entries_errors").first()["error"] == "Unknown"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(SRT)
    found = []
    query = parse_stream(stream_documents(spark, str(tmp_path / "in")), parse_srt, lambda rows, n: found.extend(clean_packets(rows, "srt").select("plain").collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    assert [r["plain"] for r in found] == ["hi"]
    packets = spark.createDataFrame([("1,0,Default,A,0,0,0,,x, y",)], "row string")
    assert event_packets(packets).select(F.col("event.text").alias("t"), "error").first() == ("x, y", None)
