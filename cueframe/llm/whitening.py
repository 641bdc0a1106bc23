"""Whitening of vectors by one-sided Jacobi rotations.

The distinct vectors, as whole numbers, are the fit list.  Their centred rows
are reduced block by block to upper triangles R (tall and skinny QR): each
task keeps one triangle, and triangles meet in ever fewer tasks until one is
left.  Plane rotations then make the columns of R orthogonal.  The product of
the rotations holds the components, and the lengths of the columns are their
standard deviations times the root of the number of rows, to full precision:
no covariance matrix is formed on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cueframe.llm.common import unused, written

#: Rows reduced at once, and triangles that meet in one task.
BLOCK = 4096
FAN_IN = 16
#: Sweeps of rotations at most; they converge quadratically, and 64 columns take about ten.
SWEEPS = 60
#: Whole numbers below this are exact in doubles.
_EXACT = 1 << 53


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of each entry ``c``, or null for vectors that are
    null or hold null or non-finite entries."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` whole numbers; what a shorter list lacks counts as 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) * width == len(flat) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, with as many rows as columns at most."""
    return np.linalg.qr(rows, mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(lengths, components)``: the singular values of ``r``, falling, and
    its right singular vectors as columns, by one-sided plane rotations.

    Each sweep rotates every pair of columns once, in rounds of pairs that do
    not touch, until all are orthogonal to double precision."""
    d = r.shape[1]
    # By an even number of columns; the one added stays zero and is no component.
    even = d + d % 2
    u, v = np.zeros((r.shape[0], even)), np.eye(even)
    u[:, :d] = r
    players = np.arange(even)
    # Columns beneath this are what rounding leaves of others, and are not rotated against each other.
    floor = np.finfo(float).eps ** 2 * (u * u).sum(axis=0).max(initial=0)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(even - 1, 0)):
            a, b = players[: even // 2], players[even // 2 :][::-1]
            x, y = u[:, a], u[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            turn = (np.abs(xy) > 1e-16 * size) & (size > floor)
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / size[turn]).max()))
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                i, j = a[turn], b[turn]
                for m in (u, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            # The next round of the tournament: all but the first move on.
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst < 1e-15:
            break
    lengths = np.sqrt((u * u).sum(axis=0))[:d]
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:d, :d][:, order]


@dataclass(frozen=True)
class Whitening:
    """What the driver knows: one number per dimension and the components."""

    n: int
    sums: list[int]
    variances: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # a column each

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.full(self.width, np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean: in whole numbers first, where they fit."""
        most = max((abs(s) for s in self.sums), default=0)
        top = int(np.abs(x).max(initial=0))
        if self.n * top + most < _EXACT:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened coordinates; NaN where nothing varies."""
        e = self.variances[:k]
        # Beneath what rounding leaves of the greatest, a variance is none.
        none = e <= self.variances.max(initial=0) * (self.width * np.finfo(float).eps) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(none, np.nan, self.centred(x) @ self.components[:, :k] / np.sqrt(e))


def distinct_vectors(rows: DataFrame, x_col: str) -> DataFrame:
    """``x``: each vector once.  Equal ones meet within tasks before they move."""
    return rows.select(F.col(x_col).alias("x")).distinct()


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension; missing
    entries count as 0.  Tasks send a sum per batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = int(np.diff(b.column(0).offsets.to_numpy()).max(initial=0))
            x = matrix(b.column(0), width)
            # Rows of their own where their sum might not fit.
            small = b.num_rows * max(int(x.max(initial=0)), -int(x.min(initial=0))) < 1 << 63
            sums = [x.sum(axis=0)] if small else list(x)
            yield pa.RecordBatch.from_pydict({"s": pa.array(sums, pa.list_(pa.int64()))})

    parts = fit.select("x").mapInArrow(partial, StructType([StructField("s", ArrayType(LongType()))]))
    found = parts.select(F.posexplode("s").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * (max((r["at"] for r in found), default=-1) + 1)
    for r in found:
        out[r["at"]] = int(r["s"])
    return fit.count(), out


def reduced(fit: DataFrame, mean: Whitening) -> np.ndarray:
    """R of the centred fit list.  A task gives one triangle of as many rows as
    there are dimensions; ``FAN_IN`` of them meet in one task of the next round."""
    width = mean.width

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                r = triangle(np.vstack([r, mean.centred(matrix(b.column(0).slice(at, BLOCK), width))]))
        yield _sent(r)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            r = triangle(np.vstack([r, _received(b, width)]))
        yield _sent(r)

    kind = StructType([StructField("r", ArrayType(DoubleType(), False))])
    rows = fit.select("x").mapInArrow(first, kind)
    parts = fit.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(meet, kind)
    found = rows.collect()  # one triangle
    return np.array([r["r"] for r in found], dtype=float).reshape(-1, width)


def _sent(r: np.ndarray) -> pa.RecordBatch:
    stops = np.arange(r.shape[0] + 1) * r.shape[1]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(r.ravel(), pa.float64()))], ["r"])


def _received(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unrotated(rows: DataFrame, x_col: str) -> tuple[Whitening | None, DataFrame]:
    """Number and sums of the distinct vectors in ``x_col``, without components yet, and those vectors."""
    vectors = written(distinct_vectors(rows.where(F.col(x_col).isNotNull()), x_col), "vectors")
    n, sums = column_sums(vectors)
    return (Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0))) if n and sums else None), vectors


def fit(rows: DataFrame, x_col: str) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors in ``x_col``, and those vectors;
    None where there are none or they have no entries."""
    mean, vectors = unrotated(rows, x_col)
    if mean is None:
        return None, vectors
    lengths, components = jacobi(reduced(vectors, mean))
    return Whitening(mean.n, mean.sums, lengths**2 / mean.n, components), vectors


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance less
    the identity, over the first ``k`` components that vary."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = model.project(matrix(b.column(0), model.width), k)
                mean = y.mean(axis=0)
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "m": [mean.tolist()], "c": [((y - mean).T @ (y - mean)).ravel().tolist()]})

    kind = StructType([StructField("n", LongType()), StructField("m", ArrayType(DoubleType())), StructField("c", ArrayType(DoubleType()))])
    parts = vectors.select("x").mapInArrow(moments, kind)
    # Each batch is centred on its own mean; what their means differ by is added.
    means = [F.sum(F.col("n") * F.col("m")[i]).alias(f"m{i}") for i in range(k)]
    spread = [F.sum(F.col("c")[i * k + j] + F.col("n") * F.col("m")[i] * F.col("m")[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    found = parts.agg(*means, *spread).first()
    mean = np.array([found[f"m{i}"] for i in range(k)], dtype=float) / model.n
    cov = np.array([found[f"c{i}_{j}"] for i in range(k) for j in range(k)], dtype=float).reshape(k, k) / model.n - np.outer(mean, mean)
    varies = np.isfinite(np.diag(cov))
    return float(np.abs(cov - np.eye(k))[np.ix_(varies, varies)].max(initial=0.0))


def transform(rows: DataFrame, model: Whitening, x_col: str, out_col: str, k: int, deviation_col: str | None = None) -> DataFrame:
    """``rows`` with ``out_col``, the first ``k`` whitened coordinates of the
    vectors in ``x_col`` (NaN for a component without variance), and on
    request ``deviation_col``, the exact sum of ``(n * x - sums) ** 2``; a sum
    beyond 64 bits is an error."""
    new = [out_col, *([deviation_col] if deviation_col else [])]
    keep = [c for c in rows.columns if c != x_col and c not in new]
    sums = np.array(model.sums, dtype=object)

    def deviations(x: np.ndarray) -> list[int]:
        most = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
        if most * most * model.width < 1 << 63:
            gap = model.n * x - sums.astype(np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = model.n * x.astype(object) - sums
        return (gap * gap).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = matrix(b.column(0), model.width)
                columns = [pa.array(list(model.project(x, k)), pa.list_(pa.float64()))]
                if deviation_col:
                    columns.append(pa.array(deviations(x), pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], [*keep, *new])

    kinds = [ArrayType(DoubleType()), LongType()]
    picked = rows.select(F.col(f"`{x_col}`"), *(F.col(f"`{c}`") for c in keep))
    return picked.mapInArrow(run, StructType([*(StructField(c, rows.schema[c].dataType) for c in keep), *(StructField(c, kind) for c, kind in zip(new, kinds, strict=False))]))


def deviations(table: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """``(id_col, n, deviation)`` of each vector that ``whiten`` takes, without its components."""
    rows = table.select(F.col(f"`{id_col}`").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("x")).where("x is not null")
    mean, _ = unrotated(rows, "x")
    if mean is None:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
    return transform(rows, mean, "x", "w", 0, "deviation").select(F.col("id").alias(id_col), F.lit(mean.n).cast("long").alias("n"), "deviation")


def whiten(table: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", k: int = 4, scale: int = 256) -> DataFrame:
    """A row ``(id_col, component, n, deviation, whitened, explained,
    identity_error)`` for each vector and each of its first ``k`` components,
    numbered from 1 by falling variance.

    Vectors that are null or hold null or non-finite entries are left out.
    Repeated vectors count once in the fit and come out once a row; a vector
    shorter than the longest counts as filled up with zeros; a component
    without variance has no whitened value (null) and explains 0, or null if
    nothing varies at all; the order of equal variances is not defined.  No
    vectors, or none with an entry, give no rows.  Other columns are not read.
    """
    (x_col,) = unused(table, "_x")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias(x_col)).where(F.col(x_col).isNotNull())
    model, vectors = fit(rows, x_col)
    kinds = StructType([StructField(id_col, table.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    if model is None:
        return table.sparkSession.createDataFrame([], kinds)
    k = min(k, model.width)
    error = identity_error(vectors, model, k)
    share = F.array(*(F.nanvl(F.lit(float(e)), F.lit(None).cast("double")) for e in model.explained[:k]))
    out = transform(rows, model, x_col, "w", k, "deviation").select("id", "deviation", F.posexplode("w").alias("at", "w"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.nanvl(F.col("w"), F.lit(None).cast("double")).alias("whitened"), F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
