"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``distance // 2 + 1`` segments.  Two
fingerprints within ``distance`` bits then have a segment that differs in one
bit at most, so they share a variant of that segment with one bit wildcarded.
Variants are indexed, joined by equality and the fingerprints in a bucket are
verified in blocks of bounded size; a block (or pair of blocks) reports a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut, hot_join, unused
from cueframe.llm.components import connected_components

BITS = 64
#: Fingerprints verified against each other at once.
BLOCK = 1024
#: Fingerprints whose variants one task makes.
TASK = 1 << 14
_CHUNK = 1 << 15
_XXH_SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bits set in over half of the shingles' XXH64; 0 without words."""
    w = text.encode("utf-8", "replace").lower().split() if text else []
    if not w:
        return 0
    if len(w) <= shingle:
        grams = [b" ".join(w)]
    else:
        grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)), strict=False)]
    digest, seed = xxhash.xxh64_intdigest, _XXH_SEED
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), _CHUNK):
        part = grams[at : at + _CHUNK]
        hashes = np.fromiter((digest(g, seed) for g in part), dtype="<u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(counts * 2 > len(grams), bitorder="little")
    return int(set_.view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; null and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """``(key, fp)``: for each bit, its segment with that bit wildcarded."""
    def bits(mask: int) -> Column:
        return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")

    keys = []
    for first, width in segments(distance):
        mask = (1 << width) - 1
        value = F.shiftrightunsigned("fp", first).bitwiseAND(bits(mask))
        keys += [value.bitwiseAND(bits(mask ^ (1 << j))).bitwiseOR(F.lit((first + j) << 32 if width <= 32 else 0).cast("long")) for j in range(width)]
    # Wide segments leave no room for the wildcard's place: a zero bit's variant is the segment itself.
    every = F.array(*keys) if all(width <= 32 for _, width in segments(distance)) else F.array_distinct(F.array(*keys))
    return fps.select("fp", F.explode(every).alias("key"))


def _forest(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``distance`` between ``a`` and ``b`` (the same block: within
    it), thinned to a spanning forest."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= distance
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if same:
        nodes = a
    else:
        nodes, j = np.concatenate([a, b]), j + len(a)
    if len(i) < 8:
        return nodes[i], nodes[j]
    root = np.arange(len(nodes))
    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return nodes[i[kept]], nodes[j[kept]]


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` whose closure joins all distinct fingerprints within ``distance``."""
    if distance < 1:
        raise ValueError("equal fingerprints are linked by grouping")
    # Small tasks: each counts the many variants of few fingerprints.
    total = fps.count()
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, total // TASK)
    keyed = variants(fps.repartition(parts, "fp"), distance)
    # Buckets beyond a block: counted by partial aggregates, and split before the exchange that gathers them.
    large = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    keyed = hot_join(keyed, large, ["key"], "n", total * BITS, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = keyed.groupBy("key", "block").agg(F.collect_list("fp").alias("fps"), F.first("blocks").alias("blocks"))
    blocks = cut(blocks.where("blocks > 1 or size(fps) > 1"))
    many = blocks.where("blocks > 1")
    # Each block goes to those of higher number, and meets them one by one.
    pairs = many.where("block + 1 < blocks").select("key", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.col("fps").alias("a"))
    pairs = pairs.join(many.select("key", "block", F.col("fps").alias("b")), ["key", "block"])
    work = blocks.where("size(fps) > 1").select(F.col("fps").alias("a"), F.lit(None).cast("array<long>").alias("b")).unionByName(pairs.select("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                got = _forest(x, b.values.to_numpy(zero_copy_only=False).view(np.uint64), distance, False) if b.is_valid else _forest(x, x, distance, True)
                if len(got[0]):
                    left.append(got[0])
                    right.append(got[1])
            if left:
                cols = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b"])

    # Two of a bucket are the common case and need no Python.
    two = work.where("b is null and size(a) = 2").select(F.col("a")[0].alias("a"), F.col("a")[1].alias("b"))
    two = two.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return two.unionByName(work.where("b is not null or size(a) > 2").mapInArrow(run, "a long, b long")).distinct()


def components_of(rows: DataFrame, distance: int = 4) -> DataFrame:
    """``rows(doc_id, fp, ...)`` with ``root``, the smallest fingerprint of its
    component, and ``component_id``, the smallest doc_id there."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    # Only fingerprints with links need a component's name; a component's rows meet it by partial aggregates.
    linked = cut(roots.join(fps, "fp"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    linked = hot_join(linked.select("fp", "root", "n"), least, ["root"], "members", linked.count()).select("fp", "root", "component_id", "n")
    alone = fps.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n")
    named = cut(linked.unionByName(alone))
    return hot_join(rows, named, ["fp"], "n", rows.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` differing bits.  Null, empty and blank texts have fingerprint
    0 and link like any other; repeated rows come back repeated; a null doc_id
    never names a component unless all its members are null; an empty table
    gives no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    return components_of(rows, distance).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each component: its smallest id (nulls last),
    of equal ids the text that hashes lowest, of equal rows any one; with all
    its columns."""
    k1, k2 = unused(docs, "_k1", "_k2")
    keyed = docs.withColumns({k1: F.xxhash64(F.lit(1), F.col(id_col).isNull(), id_col), k2: F.xxhash64(F.lit(2), F.col(text_col).isNull(), text_col)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _signed(fps)], ["doc_id", "_k1", "_k2", "fp"])

    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(k1).alias("_k1"), F.col(k2).alias("_k2"), F.col(text_col).cast("string").alias("text"))
    rows = cut(rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k2", "_k1"))
    kept = components_of(rows, distance).groupBy("root").agg(first.alias("s")).select(F.col("s._k1").alias(k1), F.col("s._k2").alias(k2))
    return keyed.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*[F.col(f"`{c}`") for c in docs.columns])


def fp_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
