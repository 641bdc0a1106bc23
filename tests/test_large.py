"""Files read in parts give the rows of the same files read whole, wherever the cuts fall."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cueframe.operators.ass import parse_ass, write_ass
from cueframe.operators.srt import parse_srt, write_srt
from cueframe.operators.vtt import parse_vtt, write_vtt
from cueframe.plans.options import AssOptions, SrtOptions
from cueframe.sources import large
from cueframe.sources.files import read_documents

RND = random.Random(11)
SRT = ["1\n00:00:01,000 --> 00:00:02,000\nhello\n\n", "9\n00:00:01,000 --> 00:00:02,000\ntwo\nlines\n\n\n", "3\r\n00:00:04,000 --> 00:00:05,000\r\nx\r\n\r\n", "20\n00:00:06,000 --> 00:00:07,000\n\n", "\n\n"]
ODD_SRT = ["00:00:01,000 --> 00:00:02,000\nno index\n\n", "orphan text\n\n", "12\nbroken\n\n", "﻿\n"]
VTT = ["00:01.000 --> 00:02.000\nhi\n\n", "name\n00:03.000 --> 00:04.000 align:start\na\nb\n\n", "NOTE x\ny\n\n", "STYLE\n::cue {}\n\n", "REGION\nid:a\n\n", "text\n\n\n", "00:01.000 --> 00:02.000\r\ncr\r\n\r\n", "00:61.000 --> 00:02.000\nno\n\n"]
ASS = ["[Events]\n", "Format: Layer, Start, Text\n", "Format: Start, End, Text\r\n", "Dialogue: 0,0:00:01.00,hello, there\n", "Comment: 1,0:00:01.00,x\n", "; note\n", "[Fonts]\n", "fontname: a\n", "!!!data\n", "[V4+ Styles]\n", "Style: a,b\n", "\n", "Key: value\n"]


def docs_of(kind):
    rnd = random.Random(kind)
    if kind == "srt":
        made = ["".join(rnd.choice(SRT) for _ in range(30)), "".join(f"{i + 1}\n00:00:01,000 --> 00:00:02,000\nentry {i}\n\n" for i in range(60)), "".join(rnd.choice(SRT + ODD_SRT) for _ in range(30)), "1\n00:00:01,000 --> 00:00:02,000\nlast", "x" * 500 + "\n" + "y" * 300, "\n\n\n"]
    elif kind == "vtt":
        made = ["WEBVTT\n\n" + "".join(rnd.choice(VTT) for _ in range(25)) for _ in range(2)] + ["WEBVTTX\n\n" + VTT[0] * 9, "﻿WEBVTT head\nmore\n" + VTT[0] * 20, "WEBVTT", "\n\nWEBVTT\n", "WEBVTT\n\nSTYLE\na\n\n" + VTT[1] * 3 + "STYLE\nb\n\nNOTE c"]
    else:
        made = ["﻿[Script Info]\n" + "".join(rnd.choice(ASS) for _ in range(40)) for _ in range(3)] + ["".join(rnd.choice([*ASS, "nonsense\n", "[open\n"]) for _ in range(60)), "[Events]"]
    return [*made, ""]


@pytest.fixture(params=["srt", "vtt", "ass"])
def folder(request, tmp_path):
    for i, text in enumerate(docs_of(request.param)):
        (tmp_path / f"d{i}.{request.param}").write_bytes(text.encode())
    return request.param, str(tmp_path)


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


def cases(kind):
    if kind == "srt":
        return [(lambda d, o=o: parse_srt(d, o), lambda p, o=o: large.parse_srt_parts(p, o)) for o in (SrtOptions(), SrtOptions(True, True, True, True))]
    if kind == "vtt":
        return [(parse_vtt, large.parse_vtt_parts)]
    return [(lambda d, o=o: parse_ass(d, o), lambda p, o=o: large.parse_ass_parts(p, o)) for o in (AssOptions(), AssOptions.lossy())]


@pytest.mark.parametrize(("split", "part"), [(400, 60)])
def test_rows_as_whole(spark, folder, split, part):
    kind, path = folder
    whole = read_documents(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        parts = large.read_parts(spark, path, cut="line" if kind == "ass" else "blank", part_bytes=part).cache()
        text = {r["doc_id"]: r["t"] for r in parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "nth", "content"))), lambda x: x["content"]), "").alias("t")).collect()}
        for r in whole.collect():
            # The text source leaves out a mark at the start, and ends the last line.
            assert text[r["doc_id"]].rstrip("\n") == r["content"].removeprefix("﻿").rstrip("\n")
        assert parts.where("head").count() == len(text)
        for plain, cut in cases(kind):
            assert rows_of(cut(parts)) == rows_of(plain(whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_text_is_shuffled(spark, tmp_path):
    """Only edges of ranges, and numbers, move."""
    (tmp_path / "a.srt").write_text(SRT[0] * 100)
    out = io.StringIO()
    with redirect_stdout(out):
        large.read_large_srt(spark, str(tmp_path)).explain()
    plan = out.getvalue()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def written_text(spark, path):
    files = spark.read.text(path, wholetext=True).select("doc_id", F.col("_metadata.file_name").alias("name"), "value")
    each = F.sort_array(F.collect_list(F.struct("name", "value")))
    return {str(r["doc_id"]): (r["t"], r["n"]) for r in files.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["value"]), "").alias("t"), F.count("*").alias("n")).collect()}


def test_files_have_the_writers_bytes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "".join(f"{i + 1}\n00:00:01,000 --> 00:00:02,000\nentry {i}\n\n" for i in range(300))), ("b", SRT[0]), ("c/d e", SRT[1])], "doc_id string, content string")
    entries = parse_srt(docs)
    large.write_srt_files(entries, str(tmp_path / "srt"), 5)
    assert {k: v[0] for k, v in written_text(spark, str(tmp_path / "srt")).items()} == {r["doc_id"]: r["content"] for r in write_srt(entries).collect()}
    assert written_text(spark, str(tmp_path / "srt"))["a"][1] > 1
    assert rows_of(large.read_large_srt(spark, str(tmp_path / "srt"))) == rows_of(parse_srt(write_srt(entries)))
    vtt = spark.createDataFrame([("a", "WEBVTT\n\n" + "".join(VTT) * 20), ("b", "WEBVTT\n")], "doc_id string, content string")
    blocks = parse_vtt(vtt)
    large.write_vtt_files(blocks, str(tmp_path / "vtt"), "made here", docs=vtt, parts=4)
    assert {k: v[0] for k, v in written_text(spark, str(tmp_path / "vtt")).items()} == {r["doc_id"]: r["content"] for r in write_vtt(blocks, "made here", vtt).collect()}
    script = spark.createDataFrame([("a", "[Events]\nFormat: Layer, Start, Text\n" + ASS[3] * 100 + "[Fonts]\nfontname: a\nxx\n")], "doc_id string, content string")
    found = parse_ass(script)
    large.write_ass_files(found, str(tmp_path / "ass"), parts=3)
    assert {k: v[0] for k, v in written_text(spark, str(tmp_path / "ass")).items()} == {r["doc_id"]: r["content"] for r in write_ass(found).collect()}


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("a").alias("doc_id"), F.col("id").alias("ordinal"), F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        large.write_rows(rows, str(tmp_path / "out"), 8)
    assert not [p for p in (tmp_path / "out").rglob("part-*") if "_temporary" not in str(p)]


def test_staging(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(SRT[0] + SRT[1])
    rows = large.read_large_srt(spark, str(tmp_path / "in"), SrtOptions(), staging=str(tmp_path / "parts"))
    assert rows.count() == 2 and (tmp_path / "parts").is_dir()
