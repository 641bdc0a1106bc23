"""Which intervals overlap, by dyadic buckets.

An interval's level is the power of two that its length needs, so it touches
two buckets of its level at most, and two of any level above.  Two intervals
that overlap share a bucket of the higher of their levels.  The one of that
level stands under its own buckets, the other under those of each level from
its own on that occurs: a cue of years has two keys beside one of seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions.arrays import let

#: Starts and ends lie between this and its negative.
MOST = 1 << 61


def level(length: Column) -> Column:
    """The least ``n`` with ``length <= 2 ** n``, for lengths from 1 on."""
    return F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)


def held(x: Column) -> Column:
    """A start or an end as a long, cut off at ``MOST``."""
    return let(x.cast("decimal(38,0)"), lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST)).cast("long")))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Each pair of a row of ``left`` and one of ``right``, whose columns but
    ``on`` get ``prefix``, that agree in ``on`` and whose intervals ``[start,
    end)`` of whole numbers overlap.

    Rows with a null in ``on``, start or end, or without length, have no
    partner; numbers are cut off at ``MOST``; repeated rows are paired each.
    A row has two keys for each level that occurs from its own on, 124 at
    most, however long it is.
    """

    def prepared(df: DataFrame, names: dict[str, str]) -> DataFrame:
        a, b = held(F.col(f"`{start}`")), held(F.col(f"`{end}`"))
        kept = [F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]
        return df.select(*kept, a.alias(names["_a"]), b.alias(names["_b"])).where(F.col(names["_a"]) < F.col(names["_b"])).withColumn(names["_own"], level(F.col(names["_b"]) - F.col(names["_a"])))

    mine = prepared(left, {"_a": "_a1", "_b": "_b1", "_own": "_own1"})
    theirs = prepared(right, {c: prefix + c for c in right.columns if c not in on} | {"_a": "_a2", "_b": "_b2", "_own": "_own2"})
    # The levels that occur: 62 numbers at most.
    own = mine.select(F.col("_own1").alias("l"))
    levels = [r["l"] for r in (own if left is right else own.union(theirs.select("_own2"))).distinct().orderBy("l").collect()]
    every = F.array(*map(F.lit, levels)).cast("array<int>")

    def keyed(df: DataFrame, n: int) -> DataFrame:
        """Rows under their buckets, in two roles: beside longer or equal ones
        of the other side, and beside shorter ones."""
        mine = F.col(f"_own{n}")
        role = lambda r, ls: F.transform(ls, lambda x: F.struct(F.lit(r).alias("role"), x.alias("level")))
        above, one = F.filter(every, lambda x: x >= mine if n == 1 else x > mine), F.array(mine)
        roles = F.concat(role(n, above), role(3 - n, one))
        leveled = df.withColumn("_at", F.explode(roles)).withColumn("_level", F.col("_at.level")).withColumn("_role", F.col("_at.role")).drop("_at")
        return leveled.withColumn("_bucket", F.explode(F.expr(f"array_distinct(array(shiftright(_a{n}, _level), shiftright(_b{n} - 1, _level)))")))

    pairs = keyed(mine, 1).join(keyed(theirs, 2), [*on, "_role", "_level", "_bucket"]).where("_a1 < _b2 and _a2 < _b1")
    # Two buckets may be shared; the later start lies in one.
    met = pairs.where(F.expr("_bucket = shiftright(greatest(_a1, _a2), _level)"))
    return met.select(*left.columns, *[prefix + c for c in right.columns if c not in on])


def _sums_before(points: DataFrame, on: list[str], at: str, sums: list[str], bits: int = 0) -> DataFrame:
    """``points``, one for each ``at`` of ``on``, with ``<sum>_before``: the
    sums over all points of a lesser ``at``.  Summed within blocks of 2 ** 16
    places, and in the same way over the blocks, so that no window is larger."""
    if bits >= 64:
        return points.select("*", *(F.coalesce(F.sum(c).over(Window.partitionBy(*on).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before") for c in sums))
    block = f"_block{bits}"
    rows = points.withColumn(block, F.shiftright(at, 16))
    within = Window.partitionBy(*on, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_in") for c in sums))
    outer = _sums_before(points.groupBy(*on, F.shiftright(at, 16).alias(block)).agg(*(F.sum(c).alias(c) for c in sums)), on, block, sums, bits + 16)
    outer = outer.select(*on, block, *(F.col(f"{c}_before").alias(f"{c}_out") for c in sums))
    return rows.join(outer, [*on, block]).select(*points.columns, *((F.col(f"{c}_in") + F.col(f"{c}_out")).alias(f"{c}_before") for c in sums))


def overlap_totals(rows: DataFrame, on: list[str], value: str, start: str = "start", end: str = "end") -> DataFrame:
    """``(*on, value, n, total)``: with how many rows each row overlaps, itself
    included, and the sum of their values, without a row for each pair.

    What overlaps ``[start, end)`` starts before its end, and does not end by
    its start: two running sums over starts and ends, whose work grows with the
    rows however many overlap.  Rows without length, or with a null in
    ``on``, start or end, are left out; repeated rows (equal ``on`` and
    ``value``) give the sum of theirs in one row.
    """
    a, b = held(F.col(start)), held(F.col(end))
    kept = rows.select(*on, F.col(value), a.alias("_a"), b.alias("_b")).where("_a < _b").dropna(subset=on)
    ends = F.array(F.struct(F.lit(0).alias("role"), F.col("_a").alias("at")), F.struct(F.lit(1).alias("role"), F.col("_b").alias("at")))
    points = kept.select(*on, value, F.explode(ends).alias("_e")).select(*on, value, F.col("_e.role").alias("_role"), F.col("_e.at").alias("_at"))
    # Dealt once, for the sums and for what is looked up in them.
    points = points.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "_at")
    number = F.coalesce(F.col(value).cast("decimal(38,0)"), F.lit(0))
    starts, stops = F.col("_role") == 0, F.col("_role") == 1
    tallies = points.groupBy(*on, "_at").agg(
        F.count_if(starts).alias("_sn"), F.count_if(stops).alias("_en"), F.sum(F.when(starts, number).otherwise(0)).cast("decimal(38,0)").alias("_sv"), F.sum(F.when(stops, number).otherwise(0)).cast("decimal(38,0)").alias("_ev")
    )
    known = _sums_before(tallies, on, "_at", ["_sn", "_en", "_sv", "_ev"])
    known = known.select(*on, "_at", *("_sn_before", "_sv_before"), (F.col("_en_before") + F.col("_en")).alias("_en_upto"), (F.col("_ev_before") + F.col("_ev")).alias("_ev_upto"))
    met = points.join(known, [*on, "_at"])
    part = lambda c: F.sum(F.when(stops, F.col(f"_s{c}_before")).otherwise(-F.col(f"_e{c}_upto")))
    return met.groupBy(*on, value).agg(part("n").alias("n"), part("v").cast("decimal(38,0)").alias("total"))
