"""Whitening agrees with a plain eigendecomposition in numpy."""

import math

import numpy as np
import pytest

from cueframe.llm import whitening
from cueframe.llm.entry import op13_embedding_whitening

SF = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def exact(vectors):
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], dtype=float) / n
    return x, n, sums, centred


def check(rows, table, k=4):
    good = [(i, v) for i, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, n, sums, centred = exact([v for _, v in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, len(sums))
    assert len(rows) == k * len(good) and all(r["n"] == n for r in rows)
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["identity_error"] < 1e-9 and math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
    signs = np.zeros(k)
    want = {}
    for (i, _), v in zip(good, x, strict=True):
        gap = [n * a - s for a, s in zip(v, sums, strict=True)]
        w = np.array(gap, dtype=float) / n @ vectors[:, :k] / np.sqrt(values[:k])
        want.setdefault((i, sum(g * g for g in gap)), []).append(w)
    assert got.keys() == want.keys()
    for key, ws in want.items():
        for c in range(k):
            a, b = sorted(got[key][c + 1]), sorted(w[c] for w in ws)
            if not signs[c] and abs(b[0]) > 0.1 and len(b) == 1:
                signs[c] = np.sign(a[0] / b[0])
    for key, ws in want.items():
        for c in range(k):
            assert np.allclose(sorted(got[key][c + 1]), sorted((signs[c] or 1) * w[c] for w in ws), atol=1e-8)


def test_whole_table(spark):
    rows = op13_embedding_whitening(spark, SF)
    assert rows.columns == COLUMNS
    check(rows.collect(), [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_edges(spark):
    """Nulls, infinities, repeated vectors and rows, clashing names, odd widths."""
    rng = np.random.default_rng(5)
    table = [(i, (rng.normal(size=5) * [9, 5, 2, 1, 0.5]).tolist()) for i in range(300)]
    hot = table[0][1]
    table += [(1000 + i, hot) for i in range(200)] + [(1, table[1][1]), (None, table[2][1])]
    table += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [0.0, float("-inf"), 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in table], "vec_id long, embedding array<double>, _x int, n int, w int").repartition(7)
    check(whitening.whiten(frame).collect(), table)


def test_nothing_or_little(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        got = whitening.whiten(spark.createDataFrame(rows, kind))
        assert got.columns == COLUMNS and got.count() == 0
        assert whitening.deviations(spark.createDataFrame(rows, kind)).count() == 0
    # One vector: nothing varies.
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == [(1, 0, None, None, 0.0)] * 4
    # Along a line: one component, the other explains nothing.
    rows = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], kind)).orderBy("vec_id", "component").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-12 for r in rows)
    assert abs(rows[0]["explained"] - 1) < 1e-12 and rows[1]["explained"] < 1e-20
    # A shorter vector counts as filled up with zeros.
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 3.0]), (3, [4.0, 0.0])], kind)).collect()
    check(short, [(1, [1.0, 0.0]), (2, [1.0, 3.0]), (3, [4.0, 0.0])])


def test_large_numbers(spark):
    """Sums and deviations are exact, and too large a deviation is an error."""
    table = [(i, [float((i * 7919) % 100) * 2.0**11, float(i)]) for i in range(50)]
    rows = whitening.deviations(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    x, n, sums, _ = exact([v for _, v in table])
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(table, x, strict=True)}
    with pytest.raises(Exception, match="(?i)overflow|too large|int too"):
        whitening.deviations(spark.createDataFrame([(i, [float(i) * 2.0**40]) for i in range(50)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize(("n", "d"), [(3, 1), (9, 2), (50, 3), (4000, 64), (40, 65), (500, 33)])
def test_jacobi(n, d):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, d)) * np.exp(rng.normal(size=d) * 3)
    blocks = np.zeros((0, d))
    for at in range(0, n, 97):
        blocks = whitening.triangle(np.vstack([blocks, a[at : at + 97]]))
    lengths, v = whitening.jacobi(blocks)
    assert np.allclose(lengths[: min(n, d)], np.linalg.svd(a, compute_uv=False), rtol=1e-10) and (np.diff(lengths) <= 0).all()
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.abs((a @ v).T @ (a @ v) - np.diag(lengths**2)).max() < 1e-13 * lengths[0] ** 2


def test_triangles_meet(spark, monkeypatch):
    """Many partitions, few of which meet at once, give the same triangle."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 10)
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, size=(300, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(13)
    mean = whitening.Whitening(len(x), x.sum(axis=0).tolist(), np.zeros(0), np.zeros((6, 0)))
    r = whitening.reduced(rows, mean)
    assert r.shape == (6, 6)
    assert np.allclose(r.T @ r, np.cov(x.T, bias=True) * len(x))
