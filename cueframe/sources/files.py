"""Documents from files and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.plans.options import AssOptions, SrtOptions

DOCUMENT = "doc_id string, content string"


def read_documents(spark: SparkSession, path: str, glob: str = "*", strict_utf8: bool = False) -> DataFrame:
    """``(doc_id, content)``: one row per file, its path and its whole text.
    ``strict_utf8`` fails on bytes that are no UTF-8 instead of replacing them."""
    if strict_utf8:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        return files.select(F.col("path").alias("doc_id"), F.expr("validate_utf8(cast(content as string))").alias("content"))
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def read_srt(spark: SparkSession, path: str, options: SrtOptions = SrtOptions()) -> DataFrame:  # noqa: B008
    from cueframe.operators.srt import parse_srt

    return parse_srt(read_documents(spark, path, "*.srt"), options)


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    from cueframe.operators.vtt import parse_vtt

    return parse_vtt(read_documents(spark, path, "*.vtt"))


def read_ass(spark: SparkSession, path: str, options: AssOptions = AssOptions()) -> DataFrame:  # noqa: B008
    from cueframe.operators.ass import parse_ass

    return parse_ass(read_documents(spark, path, "*.{ass,ssa}"), options)


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder ``doc_id=...`` with one text file for each document.  The text
    sink ends a row with LF, so a final LF of the content is left to it."""
    rows = documents.select("doc_id", F.regexp_replace("content", r"\n\z", "").alias("value"))
    rows.write.partitionBy("doc_id").text(path)
