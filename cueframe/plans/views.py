"""Parsed documents as temporary views, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cueframe.operators.ass import parse_ass
from cueframe.operators.srt import parse_srt
from cueframe.operators.vtt import parse_vtt

PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass}
NAMES = {"srt": "srt_entries", "vtt": "vtt_blocks", "ass": "ass_blocks"}


def register(docs: DataFrame, kind: str, *options) -> None:
    """``srt_entries``, ``vtt_blocks`` or ``ass_blocks``, and ``<name>_errors``."""
    rows = PARSERS[kind](docs, *options)
    rows.where("error is null").drop("error").createOrReplaceTempView(NAMES[kind])
    rows.where("error is not null").select("doc_id", "ordinal", "error").createOrReplaceTempView(f"{NAMES[kind]}_errors")
