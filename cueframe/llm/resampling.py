"""Target-distribution importance resampling in Spark SQL functions alone.

Runs of one to three words are exploded from arrays and hashed into buckets by
crc32.  The buckets of all documents and of all target texts are counted; a
table of one gain per bucket is broadcast and joined, and the gains of each
document are summed.  With Gumbel noise drawn from the document's id, the
highest scores are a sample without replacement in proportion to the weights.
A distributed sort ranks them: each row's place in its partition, plus the
rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut, unused, written

#: What stands between words, which are runs of digits, letters a to z, and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets, the words of the longest feature, and the words that a drawn document has at least.
BUCKETS = 10000
GRAMS = 3
LEAST_WORDS = 20
#: Words whose features are made from one array: bounds what a task holds of a long text besides its words.
CHUNK = 512
#: Places in a partition, by the layout of Spark's increasing ids.
_PLACES = 1 << 33


def words(text: Column) -> Column:
    """The words of a text with A to Z lower-cased and no other letter changed."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def n_features(n_words: Column) -> Column:
    return sum((F.greatest(n_words - k, F.lit(0)) for k in range(1, GRAMS)), n_words)


def features(rows: DataFrame, words_col: str, out_col: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` without ``words_col``, and in ``out_col`` the buckets of each
    row's features, one a row.  Where fewer than ``GRAMS`` words are left, the
    buckets of the runs that would take more are null, and so are all
    ``GRAMS`` of a row without words.  Nothing is shuffled."""
    chunk, *word = unused(rows, "_chunk", *(f"_word{k}" for k in range(GRAMS)))
    keep = [F.col(f"`{c}`") for c in rows.columns if c != words_col]
    w = F.col(f"`{words_col}`")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(CHUNK)))
    chunks = rows.select(*keep, F.explode_outer(F.transform(starts, lambda i: F.slice(w, i, F.lit(CHUNK + GRAMS - 1)))).alias(chunk))
    # Each word beside those that follow it.
    beside = F.arrays_zip(*(F.slice(chunk, k + 1, CHUNK).alias(name) for k, name in enumerate(word)))
    runs = chunks.select(*keep, F.inline_outer(beside)).toDF(*(c for c in rows.columns if c != words_col), *word)
    grams = [F.col(word[0])]
    for name in word[1:]:
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(name)))
    exploded = runs.select(*keep, F.explode(F.array(*grams)).alias(out_col))
    return exploded.withColumn(out_col, (F.crc32(F.col(out_col).cast("binary")) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of the features of all texts; partial sums go over the network."""
    found = features(texts.select(words(F.col(f"`{text_col}`").cast("string")).alias("w")), "w", "bucket", buckets)
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)``: a thousand times the logarithm of how much likelier
    the bucket is in ``target`` than in ``docs``, both smoothed by one, as a
    whole number.  One row for each of the ``buckets``."""
    s, t = (cut(bucket_counts(side, text_col, buckets)) for side in (docs, target))
    total = {name: float(side.agg(F.sum("n")).first()[0] or 0) for name, side in (("s", s), ("t", t))}
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, side in (("s", s), ("t", t)):
        both = both.join(F.broadcast(side.withColumnRenamed("n", name)), "bucket", "left")
    s1, t1 = (F.coalesce(F.col(name), F.lit(0)).cast("double") + 1 for name in ("s", "t"))
    odds = t1 * F.lit(total["s"] + buckets) / (s1 * F.lit(total["t"] + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``(id_col, n_words, n_features, weight, copy)``: one row per document,
    the weight being the sum of its features' gains (none: 0).  Rows are known
    by their id and 128 bits of hashes of their text; repeated rows are summed
    together, divided again, and numbered by ``copy``."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), words(text).alias("w"))
    rows = rows.select("id", "h1", "h2", F.size("w").cast("long").alias("n_words"), "w")
    found = features(rows, "w", "bucket", buckets).join(F.broadcast(gain), "bucket", "left")
    summed = found.groupBy("id", "h1", "h2", "n_words").agg(F.count("*").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    # Each word, or the lack of any, gave GRAMS rows.
    counted = summed.withColumn("per", n_features(F.col("n_words"))).withColumn("copies", F.expr(f"n div ({GRAMS} * greatest(n_words, 1L))"))
    return counted.select(F.col("id").alias(id_col), "n_words", F.col("per").alias("n_features"), F.expr("weight div copies").alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def noise(id_col: Column, seed: int = 42) -> Column:
    """A thousandfold Gumbel variate as a whole number, by hash of seed and id (null: the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, first: list[Column], rank_col: str) -> DataFrame:
    """``rows`` with ``rank_col``: 1, 2, 3... in the order of ``first``.  Rows
    are sorted over partitions by range, each keeps its place in its partition
    in a written table, and one number per partition, of those before it, is
    added.  No task takes in more than a range; ties may lie on either side of
    its end."""
    (place,) = unused(rows, "_place")
    in_order = rows.repartitionByRange(*first).sortWithinPartitions(*first)
    placed = written(in_order.withColumn(place, F.monotonically_increasing_id()), "ranked")
    part = F.expr(f"{place} div {_PLACES}L")
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["n"]
    # A row per partition.
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = placed.join(F.broadcast(table), part == F.col("_part"))
    return joined.withColumn(rank_col, F.col("_before") + F.col(place) % _PLACES + 1).drop(place, "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)`` of every document: the
    ``percent`` of the documents with ``least_words`` or more whose scores are
    highest are ranked from 1, ties to the smaller id, null ids last; the
    others have no rank.

    Null and empty texts have no features and weight 0.  Repeated rows count
    as often as they stand there and take neighbouring ranks.  An empty
    ``target`` leaves the smoothed counts of ``docs``; without documents there
    are no rows.  Other columns are not read.
    """
    gain = gains(docs, target, text_col, buckets)
    scored = weights(docs, gain, text_col, id_col, buckets)
    key = F.col(f"`{id_col}`")
    scored = scored.withColumn("score", F.col("weight") + noise(key, seed)).withColumn("fits", F.col("n_words") >= least_words)
    placed = ranked(scored, [F.desc("fits"), F.desc("score"), key.asc_nulls_last(), F.asc("copy")], "rank")
    drawn = placed.where("fits").count() * percent // 100
    return placed.select(key, "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
