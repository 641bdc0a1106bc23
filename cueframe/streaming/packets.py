"""Cue bodies and documents as streams.

Body functions and parsers are stateless: a document is whole in a row and is
parsed within it, so both hold on a stream as they do on a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueframe.functions import ass_text, srt_text, vtt_text
from cueframe.operators.ass import parse_event
from cueframe.plans.options import AssOptions, EventFormat

CLEANERS = {"srt": srt_text.plain_text, "vtt": vtt_text.plain_text, "ass": ass_text.plain_text}


def clean_packets(packets: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Packets with ``plain``, their clean text."""
    return packets.withColumn("plain", CLEANERS[kind](F.col(body)))


def event_packets(packets: DataFrame, row: str = "row", options: AssOptions = AssOptions()) -> DataFrame:  # noqa: B008
    """Container packets, whose rows begin with a read order and carry no
    times, with ``event`` and ``error``."""
    event, error = parse_event(F.lit("Dialogue"), F.col(row), EventFormat.matroska().column(), options)
    return packets.withColumns({"event": event, "error": error})


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as ``(doc_id, content)``."""
    files = spark.readStream.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def parse_stream(documents: DataFrame, parse: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parse a stream of documents and hand the rows of each micro-batch to ``sink``."""
    return parse(documents).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
