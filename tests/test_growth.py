"""Work that grows with the input, and with nothing else."""

import pytest
from pyspark.sql import functions as F

from cueframe.functions import lines
from cueframe.operators.ass import parse_ass, parse_event_line
from cueframe.operators.overlaps import overlap_totals, overlaps
from cueframe.operators.srt import parse_srt
from cueframe.operators.vtt import parse_vtt
from cueframe.plans.options import EventFormat
from cueframe.queries import QUERIES
from cueframe import rule_queries  # noqa: F401
from cueframe.sources.large import parse_srt_parts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parse", [parse_ass, parse_srt, parse_vtt])
def test_documents_are_parsed_once(spark, parse):
    """No filter below the parser repeats it."""
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("content")).repartition(2, "doc_id")
    text = plan(parse(docs))
    assert text.count("regexp_extract_all(content") + text.count("regexp_extract_all(cast(") <= 2 and "size(CASE" not in text and "Filter (size" not in text


def test_parts_are_filtered_by_no_parser(spark):
    parts = spark.createDataFrame([("a", ("", 0), 0, True, "1\n00:00:01,000 --> 00:00:02,000\nx\n")], "doc_id string, block struct<file:string,start:long>, nth int, head boolean, content string")
    rows = parse_srt_parts(parts)
    assert "Filter (size(" not in plan(rows) and rows.count() == 1


@pytest.mark.parametrize("name", ["ass_default_columns", "ass_lossy", "ass_errors", "ass_sections", "ass_event_lines", "ass_override_tags", "vtt_tree_children", "vtt_tree_depth", "vtt_bad_timings", "srt_errors", "srt_written"])
def test_rows_are_spread(spark, name):
    """A small file is no single task's work."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["srt_errors", "srt_written", "vtt_cues", "vtt_roundtrip", "vtt_bad_timings"])
def test_documents_are_read_by_batches(spark, name):
    assert "MapInArrow" in plan(QUERIES[name](spark, SF))


def test_event_lines_stay_small(spark):
    """The line is bound once, not inlined into each field."""
    event, error = parse_event_line(F.concat(F.col("id").cast("string"), F.lit("x")), EventFormat.ssa().column())
    assert plan(spark.range(1).select(event.alias("e"), error.alias("x"))).count("cast(id") < 9


def test_trims(spark):
    white = "\t\n\x0b\f\r \x85\xa0       　"
    row = spark.createDataFrame([(f"{white}a{white}b​{white}",), (white,), ("",)], "t string")
    got = row.select(lines.trim_white(F.col("t")), lines.trim_start_white(F.col("t")), lines.trim_end_white(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(f"a{white}b​", f"a{white}b​{white}", f"{white}a{white}b​"), ("", "", ""), ("", "", "")]


def test_overlap_totals(spark):
    """The counts of the pairs, with ends over many blocks, equal times, negatives, nulls and rows without length."""
    rows = [(d, i, i * 7919 % 211 - 100, i * 7919 % 211 - 100 + [1, 5, 0, 70_000, 1 << 40, 90][i % 6]) for d in "ab" for i in range(90)]
    rows += [("a", 900, None, 5), ("a", 901, 5, None), (None, 902, 1, 2), ("c", 903, -(1 << 62), 1 << 62), ("c", 904, 3, 4), ("a", 905, 9, 8)]
    df = spark.createDataFrame(rows, "doc string, id long, start long, end long")
    pairs = overlaps(df, df, ["doc"]).groupBy("doc", "id").agg(F.count("*").alias("n"), F.sum("other_id").alias("total")).collect()
    got = overlap_totals(df, ["doc"], "id").collect()
    assert sorted((r["doc"], r["id"], r["n"], int(r["total"])) for r in got) == sorted(tuple(r) for r in pairs)


def test_many_overlaps_make_no_pairs(spark):
    cues = spark.range(200_000).select(F.lit(1).alias("doc"), "id", F.lit(0).alias("start"), (F.col("id") + 1).alias("end"))
    got = overlap_totals(cues, ["doc"], "id").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(got) == (200_000, 200_000, 200_000)


def test_unit_values_of_large_keys(spark, tmp_path):
    """Keys whose multiples pass 64 bits."""
    spark.createDataFrame([(1_200_000, 30), (2001, 3)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: r["long_hour"] for r in QUERIES["unit_values"](spark, str(tmp_path)).collect()}
    assert got == {1_200_000: "ParseInt", 2001: "ParseInt"}


def test_references_end_at_tags(spark, tmp_path):
    """The query and its SQL agree where a tag cuts a reference, and at a tag without an end."""
    import duckdb

    from cueframe.queries import ORACLE_SQL

    spark.createDataFrame([(1, "a&am</b>p;b&amp;c &amp<i"), (2, "&quot;x&copy;<a href='?&amp;'>&am<b>p{")], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = dict(QUERIES["vtt_charrefs"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert dict(c.execute(ORACLE_SQL["vtt_charrefs"]).fetchall()) == got == {1: "a&amp;b&c &", 2: '"x\u00a9&amp{'}
