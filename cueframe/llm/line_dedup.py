"""Removal of lines that many sites share, by HyperLogLog spread.

Per line hash two sketches count the distinct sites and the distinct texts it
stands in; sketches merge by aggregation, so a line on a third of all pages is
no heavier than any other.  Lines whose estimate lies near the threshold are
counted exactly.  The removed lines of a document are joined to it by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut, hot_join, unused, written


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that is not blank: two 64-bit line hashes, the hashes
    of its site, its text and the document's id, and its position."""
    hashes = [F.xxhash64(site_col, F.lit(0)).alias("site"), F.xxhash64(F.col(text_col), F.lit(1)).alias("t1"), F.xxhash64(F.col(id_col), F.lit(2)).alias("t2")]
    rows = docs.select(*hashes, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "site", "t1", "t2", "pos")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 10) -> DataFrame:
    """``(h1, h2, n)`` of the lines in at least ``min_sites`` sites and as many
    texts, ``n`` being how often each stands there."""
    keys = ["h1", "h2"]
    # A line of one site or one text cannot be spread: longs only, so this first pass stays a hash aggregate.
    some = lines.groupBy(*keys).agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min("t1").alias("c"), F.max("t1").alias("d"), F.count("*").alias("n"))
    some = cut(some.where((F.col("a") < F.col("b")) & (F.col("c") < F.col("d")) & (F.col("n") >= min_sites)).select(*keys, "n"))
    total = lines.count()
    # No hot line is moved before its sketches have merged.
    sketches = hot_join(lines, some, keys, "n", total, "left_semi").groupBy(*keys).agg(F.hll_sketch_agg("site", lg_k).alias("s"), F.hll_sketch_agg("t1", lg_k).alias("t"), F.count("*").alias("n"))
    counts = sketches.select(*keys, "n", F.least(F.hll_sketch_estimate("s"), F.hll_sketch_estimate("t")).alias("spread"))
    band = max(1.0, 4 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    counts = cut(counts.where(F.col("spread") >= min_sites - band))
    near = counts.where(F.col("spread") <= min_sites + band).select(*keys, "n")
    exact = hot_join(lines, near, keys, "n", total, "left_semi").groupBy(*keys).agg(F.countDistinct("site").alias("s"), F.countDistinct("t1").alias("t"), F.count("*").alias("n"))
    exact = exact.where((F.col("s") >= min_sites) & (F.col("t") >= min_sites)).select(*keys, "n")
    return cut(counts.where(F.col("spread") > min_sites + band).select(*keys, "n").unionByName(exact))


def remove_spread_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, max_share: float = 0.5
) -> DataFrame:
    """``docs`` with the cleaned text, and ``n_lines_removed``.

    A line, trimmed, is boilerplate if it stands in at least ``min_sites``
    distinct sites and distinct texts: copies of one text spread nothing.  A
    document whose boilerplate exceeds ``max_share`` of its characters has no
    frame around content of its own; it is left whole, for near-duplicate
    removal to judge.  With a share of 1 the lines go wherever they stand, and
    the rest may be empty.  Null and empty texts come back as they are, blank lines
    stay, a null site is a site of its own, repeated rows are treated alike
    and an empty table gives no rows.  Columns beside the text keep names and
    values, but for one called ``n_lines_removed``, which is replaced.
    """
    t1, t2, gone_, kept_ = unused(docs, "_t1", "_t2", "_gone", "_kept")
    # Texts are split and hashed once; what follows reads the hashes.
    lines = written(lines_of(docs, id_col, text_col, site_col), "lines")
    spread = spread_lines(lines, min_sites)
    keyed = docs.withColumn(t1, F.xxhash64(F.col(text_col), F.lit(1))).withColumn(t2, F.xxhash64(F.col(id_col), F.lit(2)))
    found = hot_join(lines, spread, ["h1", "h2"], "n", lines.count(), "left_semi")
    gone = found.groupBy("t1", "t2").agg(F.collect_set("pos").alias(gone_)).withColumnsRenamed({"t1": t1, "t2": t2})
    lines = F.split(text_col, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone_), i)), "\n")
    joined = keyed.join(gone, [t1, t2], "left").withColumn(kept_, F.when(F.col(gone_).isNotNull(), kept))
    cut_ = F.length(F.col(text_col)) - F.length(kept_) <= F.length(F.col(text_col)) * F.lit(max_share)
    clean = F.when(F.col(gone_).isNotNull() & cut_, F.col(kept_)).otherwise(F.col(text_col))
    n = F.when(F.col(gone_).isNotNull() & cut_, F.size(gone_)).otherwise(0).cast("long")
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_lines_removed"], n.alias("n_lines_removed"))
