"""Array expressions that Spark has no one function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that a running fold takes in one go.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str, made: Callable[[Column, Column], Column] | None = None, kind: str | None = None) -> Column:
    """The states of a fold before each item, or what ``made`` makes of state
    and item.  ``state`` and ``kind`` are their types.

    Arrays are copied as they grow, so what is made is gathered by chunks, and
    time grows with the items but for a small part.  Where states may grow,
    ``made`` keeps them from being held all at once.
    """
    zero, out = zero.cast(state), kind or state
    pair, whole = f"struct<now:{state},seen:array<{out}>>", f"struct<now:{state},seen:array<array<{out}>>>"

    def one(acc: Column, item: Column) -> Column:
        new = acc["now"] if made is None else made(acc["now"], item).cast(out)
        return F.struct(step(acc["now"], item).cast(state).alias("now"), F.concat(acc["seen"], F.array(new)).alias("seen")).cast(pair)

    def many(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["now"].alias("now"), F.array().cast(f"array<{out}>").alias("seen")).cast(pair)
        return F.aggregate(chunk, start, one, lambda got: F.struct(got["now"].alias("now"), F.concat(acc["seen"], F.array(got["seen"])).alias("seen")).cast(whole))

    def run(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(zero.alias("now"), F.array().cast(f"array<array<{out}>>").alias("seen")).cast(whole)
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(chunks, begin, many)["seen"])).otherwise(F.array().cast(f"array<{out}>"))

    return let(items, run)


def exploded(rows: DataFrame, items: str, at: str, item: str) -> DataFrame:
    """Other columns, ``at`` and ``item`` for each of ``items``.  Spark puts a
    filter on the size of what an inner explode takes below whatever lies under
    it, where the items are then made as often as their expression is inlined;
    an outer one has none, and its rows without an item are left out."""
    others = [c for c in rows.columns if c != items]
    return rows.select(*others, F.posexplode_outer(items).alias(at, item)).where(F.col(at).isNotNull())


def first_place(items: Column, test: Callable[[Column], Column]) -> Column:
    """The place, from 1, of the first item that passes; 0 if none does."""
    return F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)).cast("int")
