"""Mixing sources to target weights by entropy balancing.

For each source the document rates ``r = min(cap, exp(t * size / mean size))``
are the least-information change of "one copy each" that takes the source's
target of words; the multiplier ``t`` solves the convex dual of that token
constraint.  All sources take their safeguarded Newton steps together, each
step one distributed aggregate over a histogram of document sizes.  Rates are
then rounded into copies, largest documents first, carrying the error on, so
that a source misses its target by about half of its smallest document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import cut, n_words, unused

#: Documents of one source and size are ranked within this many hashed parts, or more, so that a part holds about so many rows at most.
PARTS = 64
PART_ROWS = 1 << 20


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``_rank`` from 0 by ``key``, without one global sort task:
    ranges of keys are ranked apart and moved on by the sizes of those before."""
    apart = cut(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    ahead = apart.groupBy("_part").count()
    ahead = ahead.withColumn("_ahead", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return apart.withColumn("_rank", within).join(ahead, "_part").withColumn("_rank", F.col("_rank") + F.col("_ahead")).drop("_part", "_ahead")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sources(_k, total)`` -> the same with ``target``: ``share`` of all words
    by weight, the weights repeating in key order; a target stops at ``cap``
    times its source and the excess is shared out anew until none is above."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(ranked(sources, "_k").withColumn("_w", cycle[(F.col("_rank") % len(weights)).cast("int")]).drop("_rank"))
    most = F.col("total") * F.lit(float(cap))
    all_words = sources.agg(F.sum("total")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) >= most
        taken, left, n = sources.agg(
            F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))), F.sum(over.cast("long"))
        ).first()
        if not left or n == full:
            break
        level, full = (share * all_words - taken) / left, n
    return sources.withColumn("target", F.least(F.col("_w") * F.lit(level), most) if all_words else F.lit(0.0))


def tilts(hist: DataFrame, targets: DataFrame, cap: float, rounds: int = 60, tol: float = 1e-10) -> DataFrame:
    """Newton steps on the dual, all sources at once: ``(_k, _mean, _t)``.
    A step that leaves the bracket of its root becomes a bisection."""
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("total") * F.lit(cap * (1 - 1e-12)))
    state = targets.where(open_).select(
        "_k", "target",
        (F.col("total") / F.col("docs")).alias("_mean"),
        F.lit(0.0).alias("_t"),
        (F.least(F.log(F.col("target") / F.col("total")), F.lit(0.0)) * F.col("total") / F.col("docs") / F.col("least") - 1e-9).alias("_lo"),
        (F.lit(math.log(cap)) * F.col("total") / F.col("docs") / F.col("least")).alias("_hi"),
        F.lit(False).alias("_done"),
    )
    state = cut(state)
    for _ in range(rounds):
        x = F.col("size") / F.col("_mean")
        rate = F.least(F.exp(F.least(F.col("_t") * x, F.lit(700.0))), F.lit(float(cap)))
        words = F.col("n") * F.col("size") * rate
        sums = (
            hist.join(state.where("not _done").select("_k", "_t", "_mean"), "_k")
            .groupBy("_k")
            .agg(F.sum(words).alias("_f"), F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("_slope"))
        )
        gap = F.col("_f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("_t")).otherwise(F.col("_lo")), F.when(gap > 0, F.col("_t")).otherwise(F.col("_hi"))
        step = F.col("_t") - gap / F.when(F.col("_slope") > 0, F.col("_slope"))
        near = (F.abs(gap) <= F.col("target") * tol) | (hi - lo <= 1e-14 * (F.abs(lo) + F.abs(hi)))
        moved = F.when(near | F.col("_done"), F.col("_t")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        live = F.col("_f").isNotNull()
        state = cut(
            state.join(sums, "_k", "left").select(
                "_k", "target", "_mean",
                F.when(live, moved).otherwise(F.col("_t")).alias("_t"),
                F.when(live, lo).otherwise(F.col("_lo")).alias("_lo"),
                F.when(live, hi).otherwise(F.col("_hi")).alias("_hi"),
                (F.col("_done") | F.coalesce(near, F.lit(True))).alias("_done"),
            )
        )
        if state.where("not _done").isEmpty():
            break
    return state.select("_k", "_mean", "_t")


def _round_source(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source, the largest first; what one size
    takes too much or too little the next ones make good."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    owed, copies = 0.0, []
    for size, n, rate, most in zip(cells["size"], cells["n"], cells["rate"], cells["most"], strict=True):
        want = n * rate + (owed / size if size else 0.0)
        got = int(min(max(math.floor(want + 0.5), 0), n * most))
        owed += (n * rate - got) * size
        copies.append(got)
    return pd.DataFrame({"_k": cells["_k"], "size": cells["size"], "n": cells["n"], "copies": copies})


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """Every row's id with ``size``, ``source``, ``source_size``, ``target`` and ``copies`` (0..cap).

    Null texts and texts without words have size 0 and are kept once; a null
    source is a source of its own, last in order.  Ties between documents of
    one source and size go by a hash of the id, so reruns agree; repeated rows
    count separately, an empty table gives no rows and other columns of the
    input, whatever their names, play no part.

    A source is never gathered: ranks within a (source, size) are taken in
    hashed parts, ``PARTS`` or more.  One task rounds the histogram of one source,
    whose rows are distinct sizes, at most ``sqrt(2 * words)`` of them.
    """
    key = F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_t"))
    # Rows without an id are dealt out by where they are read: among these, none is told from another of its text.
    dealt = F.when(F.col("id").isNull(), F.col("_t") + F.spark_partition_id()).otherwise(F.col("_h"))
    rows = rows.withColumns({"_h": F.xxhash64("id"), "_k": key}).withColumn("_b", F.pmod(dealt, F.lit(max(PARTS, rows.count() // PART_ROWS))).cast("int")).select("id", "size", "_k", "_h", "_b")
    order = Window.partitionBy("_k", "size", "_b").orderBy("_h", "id")
    rows = cut(rows.withColumn("_r", F.row_number().over(order)).drop("_h"))
    parts = rows.groupBy("_k", "size", "_b").agg(F.count("*").alias("_n"))
    parts = cut(parts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("_k", "size").orderBy("_b")) - F.col("_n")))
    hist = cut(parts.groupBy("_k", "size").agg(F.sum("_n").alias("n")))
    totals = hist.groupBy("_k").agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    targets = cut(source_targets(totals, weights, share, cap))
    tilt = tilts(hist, targets, cap)
    full = F.col("target") >= F.col("total") * F.lit(cap * (1 - 1e-12))
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(cap)).when(F.col("target") <= 0, 0.0)
    rate = rate.otherwise(F.least(F.exp(F.least(F.col("_t") * F.col("size") / F.col("_mean"), F.lit(700.0))), F.lit(float(cap))))
    cells = hist.join(targets, "_k").join(tilt, "_k", "left").select("_k", "size", "n", rate.alias("rate"), F.lit(cap).alias("most"))
    cells = cells.groupBy("_k").applyInPandas(_round_source, "_k string, size long, n long, copies long")
    cells = parts.drop("_n").join(cells, ["_k", "size"])
    cells = cells.join(targets.select("_k", F.col("total").alias("source_size"), "target"), "_k")
    every = F.floor(F.col("copies") / F.col("n"))
    more = (F.col("_ahead") + F.col("_r") <= F.col("copies") - every * F.col("n")).cast("long")
    source = F.when(F.col("_k") == "2", F.lit(None)).otherwise(F.substring("_k", 2, 1 << 30))
    return rows.join(cells, ["_k", "size", "_b"]).select(
        F.col("id").alias(id_col), source.alias("source"), "size", "source_size", "target", (every + more).alias("copies")
    )


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as mixed: each row as often as ``mix_sources`` takes it, with
    all its columns.  Rows are known by 128 bits of hashes of id, source and
    text; of rows equal in these, one stands for all."""
    name, copy, times = unused(docs, "_row", "_copy", "_copies")
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.withColumn(name, F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (5, 55)]))
    copies = mix_sources(keyed, name, source_col, text_col, **options).groupBy(name).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    each = keyed.dropDuplicates([name]).join(copies, name)
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
