"""A training corpus from raw documents: five operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm import bpe, language, line_dedup, mixing, simhash
from cueframe.llm.common import table, written
from cueframe.llm.entry import language_model, ranks_path

#: Stages learn, sketch, solve and hash; SQL does not express them.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return language.accepted(docs, language_model(docs), host=F.col("source"))


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go, whatever share of a text they make, and ``n_chars`` follows."""
    clean = line_dedup.remove_spread_lines(docs, max_share=1.0)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) of every document, the
    offsets of its pieces, and the digest of what they decode to."""
    path = ranks_path()
    both = bpe.encode(docs, path, offsets_col="offsets", decoded_col="decoded", keep=["doc_id", "source"])
    return both.select("doc_id", "source", bpe.n_tokens().alias("n_tokens"), "ids", "offsets", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_shared_lines),
    ("SimHash near-dedup", remove_near_duplicates),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written once, and read by the next as
    often as that needs it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
