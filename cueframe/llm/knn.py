"""Exact top-k inner products by a Voronoi join.

Queries and data are grouped by their nearest pivot.  Summaries of the groups
(distances to the pivot, norms, the k members nearest to it) give each group
of queries, and then each query, a product that k rows are sure to reach and
each group of data a product that none of its members exceeds.  Data that no
group of queries may need are dropped; the rest is sent once, to blocks of
neighbouring groups, and a query goes to the blocks that hold a group it may
need.  Each block is solved with matrix products, and the best of all blocks
are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import cut

#: Vectors and queries in one block.
BLOCK = 16384
QUERY_BLOCK = 8192
#: Pivots: about the square root of the rows, this many at most (a bounded sample; results do not depend on it).
MOST_PIVOTS = 1024
#: Products below this are exact in doubles, those below the next in 64-bit integers.
_DOUBLES, _LONGS = 2.0**53, 2.0**63


def quantised(vector: str, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component, or null for vectors that are
    null or hold null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; missing components count as 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


@dataclass(frozen=True)
class Groups:
    """What the driver knows: a row per pivot on each side."""

    pivots: np.ndarray
    need: np.ndarray  # (groups of queries, groups of data): may a query need a member
    floor: np.ndarray  # what k members are sure to reach, per group of queries
    members: np.ndarray  # rows of each group of data
    asked: np.ndarray  # queries of each group
    least: np.ndarray  # members nearer to their pivot than this are needed by none
    first: np.ndarray  # first block of each group of data, and how many it fills
    parts: np.ndarray
    copies: np.ndarray  # parts that the queries of a block are split into

    @property
    def kept_share(self) -> float:
        """The share of (query, row) pairs that the bounds of groups leave."""
        pairs = self.asked[:, None] * self.members[None, :]
        return float((pairs * self.need).sum() / max(pairs.sum(), 1))


def _bounds(dots: np.ndarray, gaps: np.ndarray, norm_a: np.ndarray, most_a: np.ndarray, least_a: np.ndarray, r_a: np.ndarray, norm_b: np.ndarray, r_b: np.ndarray, most_b: np.ndarray, least_b: np.ndarray):
    """(sure, most) inner products of ``a`` and ``b`` from the products and
    distances of their centres, the centres' norms, the members' norms and
    their greatest distance from the centre; arrays broadcast."""
    slack = norm_a * r_b + r_a * norm_b + r_a * r_b
    far, near = gaps + r_a + r_b, np.maximum(gaps - r_a - r_b, 0)
    sure = np.maximum(dots - slack, (least_a**2 + least_b**2 - far**2) / 2)
    most = np.minimum(np.minimum(dots + slack, (most_a**2 + most_b**2 - near**2) / 2), most_a * most_b)
    # Doubles round; what they lose is far below this.
    eps = 1e-9 * (most_a * most_b + norm_a * norm_b) + 1e-6
    return sure - eps, most + eps


def _gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dots = a @ b.T
    return dots, np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * dots, 0))


def plan(pivots: np.ndarray, data: pd.DataFrame, near: pd.DataFrame, queries: pd.DataFrame, k: int) -> tuple[Groups, np.ndarray, np.ndarray]:
    """Bounds of all pairs of groups, from one row per group: ``data`` and
    ``queries`` hold ``g, n, far, least, most`` (members, distance of the
    farthest, least and greatest norm), ``near`` the ``g, d, norm`` of the
    k + 1 members nearest to each pivot."""
    p = len(pivots)

    def column(df: pd.DataFrame, name: str, empty: float = 0.0) -> np.ndarray:
        out = np.full(p, empty)
        out[df["g"].to_numpy(dtype=np.intp)] = df[name].to_numpy(dtype=float)
        return out

    dots, gaps = _gaps(pivots, pivots)
    norms = np.sqrt((pivots * pivots).sum(axis=1))
    asked, members = column(queries, "n"), column(data, "n")
    qr, ql, qm = column(queries, "far"), column(queries, "least"), column(queries, "most")
    dr, dl, dm = column(data, "far"), column(data, "least"), column(data, "most")
    ng, nd, nn = near["g"].to_numpy(dtype=np.intp), near["d"].to_numpy(dtype=float), near["norm"].to_numpy(dtype=float)
    sure, _ = _bounds(dots[:, ng], gaps[:, ng], norms[:, None], qm[:, None], ql[:, None], qr[:, None], norms[ng][None], nd[None], nn[None], nn[None])
    # One of k + 1 may be the query's own row, so k are sure to remain.
    floor = -np.partition(-sure, k, axis=1)[:, k] if len(ng) > k else np.full(p, -np.inf)
    _, most = _bounds(dots, gaps, norms[:, None], qm[:, None], ql[:, None], qr[:, None], norms[None], dr[None], dm[None], dl[None])
    need = (most >= floor[:, None]) & (asked > 0)[:, None] & (members > 0)[None]
    # How far from the pivot a member must lie to be needed: halving, for all groups at once.
    low, high = np.zeros(p), dr.copy()
    for _ in range(30):
        mid = (low + high) / 2
        reach = _bounds(dots, gaps, norms[:, None], qm[:, None], ql[:, None], qr[:, None], norms[None], mid[None], dm[None], dl[None])[1]
        some = ((reach >= floor[:, None]) & need).any(axis=0)
        low, high = np.where(some, low, mid), np.where(some, mid, high)
    least = np.where(need.any(axis=0), low, np.inf)
    # Neighbouring groups share a block; a group beyond a block fills several of its own.
    order, left = [], np.flatnonzero(need.any(axis=0))
    at = left[0] if len(left) else 0
    while len(left):
        order.append(at)
        left = left[left != at]
        if len(left):
            at = left[gaps[at, left].argmin()]
    first, parts = np.zeros(p, dtype=np.int64), np.ones(p, dtype=np.int64)
    block, used = 0, 0.0
    for g in order:
        if used and used + members[g] > BLOCK:
            block, used = block + 1, 0.0
        first[g], parts[g] = block, max(1, -(-int(members[g]) // BLOCK))
        used += members[g]
        if used >= BLOCK:
            block, used = block + int(parts[g]), 0.0
    load = np.zeros(block + 1)
    wanted: dict[int, np.ndarray] = {}
    for g in order:
        wanted[first[g]] = wanted.get(first[g], np.zeros(p, dtype=bool)) | need[:, g]
    for b, who in wanted.items():
        load[b] = asked[who].sum()
    copies = np.maximum(1, -(-load // QUERY_BLOCK)).astype(np.int64)
    return Groups(pivots, need, floor, members, asked, least, first, parts, copies), nd, nn


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the one farthest from those before: every cluster of
    the sample gets one before any gets two."""
    norm = (sample * sample).sum(axis=1)
    at, gap, chosen = int(norm.argmin()), np.full(len(sample), np.inf), []
    while len(chosen) < n and gap[at] > 0:
        chosen.append(at)
        gap = np.minimum(gap, np.maximum(norm + norm[at] - 2 * sample @ sample[at], 0))
        gap[at] = 0
        at = int(gap.argmax())
    return sample[chosen]


def _typed(most: int) -> np.dtype:
    """The smallest integers that hold components up to ``most``."""
    return next(np.dtype(t) for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its ``k`` highest scores, ties to the first
    place, as a mask."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    above = scores > kth
    level = scores == kth
    short = k - above.sum(axis=1, keepdims=True)
    return above | (level & (np.cumsum(level, axis=1) <= short))


def top_k(
    embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", told: list[Groups] | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible
    by ``every``, the ``k`` other rows of highest integer inner product, fewer
    if there are fewer, ties to the smaller id.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part.  Every row is a row of its own: of repeated rows
    each is asked for and each is found, and rows of one id may hold different
    vectors.  A shorter vector's missing components count as 0, an empty
    vector scores 0 with all; an empty table gives no rows; other columns are
    not read.  Scores are exact integers; vectors so long that a score might
    not fit into 64 bits (squared norm of ``2 ** 63`` or more) raise
    ``ValueError``.  Groups beyond ``BLOCK`` rows are split, and so are their
    queries beyond ``QUERY_BLOCK``; a task holds one of each.  ``told``, if
    given, takes the bounds that were used.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_x"), quantised(vector_col).alias("v")).where("vec_id is not null and v is not null")
    square = F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * 256.0).cast("double"), 2))
    n, widest, norm2, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if norm2 >= _LONGS:
        raise ValueError(f"scores of vectors with squared norm {norm2} may not fit into 64 bits")
    width, kind, exact = max(widest, 1), _typed(most or 0), norm2 < _DOUBLES
    wanted = min(MOST_PIVOTS, max(1, int(n**0.5)))

    # Ids of rows are set once, before the checkpoint that all later steps read.
    rows = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _rows(b.column(1), width).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], ["row", "vec_id", "v"])

    rows = cut(rows.mapInArrow(packed, "row long, vec_id long, v binary"))

    def matrix(column: pa.Array | pd.Series) -> np.ndarray:
        parts = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
        return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), width)

    # Pivots: from the distinct vectors of the rows whose ids hash lowest; the bound leaves a few times as many as are wanted.
    span = 2.0**64
    bound = int(min(1.0, 4.0 * wanted / n) * span - span / 2)
    hashed = rows.where(F.xxhash64("row", F.lit(8)) <= F.lit(max(min(bound, 2**63 - 1), -(2**63))).cast("long")) if n > 8 * wanted else rows
    sample = sorted({bytes(r["v"]) for r in hashed.select("v").limit(16 * wanted).collect()}) or [bytes(rows.select("v").first()["v"])]
    pivots = spread_out(np.frombuffer(b"".join(sample), dtype=kind).reshape(-1, width).astype(float), wanted)
    sent = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        half = (p * p).sum(axis=1) / 2
        for b in batches:
            x = matrix(b.column(2)).astype(float)
            g = (half - x @ p.T).argmin(axis=1)
            d, norm = np.sqrt(((x - p[g]) ** 2).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int32()), pa.array(d), pa.array(norm)], ["row", "vec_id", "v", "g", "d", "norm"])

    placed = cut(rows.mapInArrow(nearest, "row long, vec_id long, v binary, g int, d double, norm double"))
    asking = F.col("vec_id") % every == 0
    shape = [F.count("*").alias("n"), F.max("d").alias("far"), F.min("norm").alias("least"), F.max("norm").alias("most")]
    # A row per pivot on each side, and k + 1 more of each group of data.
    data, queries = placed.groupBy("g").agg(*shape).toPandas(), placed.where(asking).groupBy("g").agg(*shape).toPandas()
    if not len(queries):
        return spark.createDataFrame([], schema)
    ahead = F.row_number().over(Window.partitionBy("g").orderBy("d"))
    near = placed.select("g", "d", "norm").withColumn("_at", ahead).where(F.col("_at") <= k + 1).drop("_at").toPandas()
    groups, near_d, near_norm = plan(pivots, data, near, queries, k)
    if told is not None:
        told.append(groups)
    side = {"far": np.zeros(len(pivots)), "least": np.zeros(len(pivots)), "most": np.zeros(len(pivots))}
    for name, values in side.items():
        values[data["g"].to_numpy(dtype=np.intp)] = data[name].to_numpy(dtype=float)
    known = spark.sparkContext.broadcast((groups, near["g"].to_numpy(dtype=np.intp), near_d, near_norm, side))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row that a group of queries may need: once, or once for each part of its block's queries."""
        of = known.value[0]
        for b in batches:
            g, d = b.column(3).to_numpy(), b.column(4).to_numpy()
            i = np.flatnonzero(d >= of.least[g] * (1 - 1e-9) - 1e-6)
            row = b.column(0).to_numpy()[i]
            block = of.first[g[i]] + (row * 0x9E3779B1 & 0x7FFFFFFF) % of.parts[g[i]]
            copies = of.copies[of.first[g[i]]]
            j = np.repeat(np.arange(len(i)), copies)
            part = np.arange(len(j)) - np.repeat(np.cumsum(copies) - copies, copies)
            if len(j):
                pick = pa.array(i[j])
                yield pa.RecordBatch.from_arrays([pa.array(block[j]), pa.array(part), *(b.column(c).take(pick) for c in range(3))], ["block", "part", "row", "vec_id", "v"])

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block that it may need, by bounds of its own."""
        of, ng, nd, nn, by = known.value
        p = sent.value
        norms = np.sqrt((p * p).sum(axis=1))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                x = matrix(c.column(2)).astype(float)
                g, row, own = c.column(3).to_numpy(), c.column(0).to_numpy(), c.column(5).to_numpy()[:, None]
                dots, gaps = _gaps(x, p)
                none = np.zeros(1)
                sure, _ = _bounds(dots[:, ng], gaps[:, ng], own, own, own, none, norms[ng][None], nd[None], nn[None], nn[None])
                floor = -np.partition(-sure, k, axis=1)[:, k] if len(ng) > k else np.full(len(x), -np.inf)
                _, most = _bounds(dots, gaps, own, own, own, none, norms[None], by["far"][None], by["most"][None], by["least"][None])
                i, j = np.nonzero(of.need[g] & (most >= np.maximum(floor, of.floor[g])[:, None]))
                reps = of.parts[j]
                i, first = np.repeat(i, reps), np.repeat(of.first[j], reps)
                block = first + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
                both = np.unique(np.stack([i, block, first], axis=1), axis=0)
                if len(both):
                    i, block, first = both.T
                    part = (row[i] * 0x9E3779B1 & 0x7FFFFFFF) % of.copies[first]
                    pick = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(part), *(c.column(m).take(pick) for m in range(3))], ["block", "part", "q_row", "query_id", "q"])

    there = placed.mapInArrow(needed, "block long, part long, row long, vec_id long, v binary")
    here = placed.where(asking).mapInArrow(sought, "block long, part long, q_row long, query_id long, q binary")

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(a) or not len(b):
            return pd.DataFrame({"q_row": [], "query_id": [], "vec_id": [], "row": [], "score": []})
        b = b.sort_values(["vec_id", "row"], kind="stable")
        row, vec = b["row"].to_numpy(), b["vec_id"].to_numpy()
        x, y = matrix(a["q"]), matrix(b["v"])
        # Doubles hold every sum below their bound; beyond it, integers do.
        x, y = (x.astype(float), y.astype(float)) if exact else (x.astype(np.int64), y.astype(np.int64))
        out = []
        for at in range(0, len(a), 128):
            q_row, query = a["q_row"].to_numpy()[at : at + 128], a["query_id"].to_numpy()[at : at + 128]
            score = (x[at : at + 128] @ y.T).astype(np.int64)
            found = best_of(score, k + 1)  # one may be the query's own row
            found[q_row[:, None] == row[None, :]] = False
            i, j = np.nonzero(found)
            out.append(pd.DataFrame({"q_row": q_row[i], "query_id": query[i], "vec_id": vec[j], "row": row[j], "score": score[i, j]}))
        return pd.concat(out)

    keys = ["block", "part"]
    local = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(solve, "q_row long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
