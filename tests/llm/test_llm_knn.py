"""The nearest vectors agree with all products computed."""

import math
import random

import numpy as np
import pytest

from cueframe.llm import knn
from cueframe.llm.entry import op8_exact_top_k

SF = "/root/testdata/sf0.001"


def plain(rows, every=50, k=5):
    """All products, in whole numbers of any size; every row is one of its own."""
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in whole), default=0)
    m = np.array([v + [0] * (width - len(v)) for _, v in whole], dtype=object).reshape(len(whole), width)
    small = width and max((sum(x * x for x in v) for v in m.tolist()), default=0) < 2**53
    m = m.astype(np.int64) if small else m
    out = []
    for at, (q, _) in enumerate(whole):
        if q % every == 0:
            s = (m @ m[at]).tolist() if width else [0] * len(whole)
            best = sorted((-int(x), whole[j][0]) for j, x in enumerate(s) if j != at)[:k]
            out += [(q, rank, i, -x) for rank, (x, i) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(op8_exact_top_k(spark, SF)) == plain(rows)


def test_blocks(spark, monkeypatch):
    """A hot cluster of equal vectors, over several blocks on both sides."""
    monkeypatch.setattr(knn, "BLOCK", 32)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    rng = random.Random(8)
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    assert rows_of(knn.top_k(df, every=5)) == plain(rows, every=5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [5.0, 0.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (7, [1.0, 2.0]), (3, [1.0]), (None, [9.0, 9.0]), (250, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, row int")
    assert rows_of(knn.top_k(df)) == plain(rows)
    assert rows_of(knn.top_k(df.limit(0))) == []
    assert rows_of(knn.top_k(df.where("vec_id = 3"))) == []
    assert rows_of(knn.top_k(df.where("vec_id = 7"))) == []
    empty = [(i, []) for i in range(0, 400, 25)]
    assert rows_of(knn.top_k(spark.createDataFrame(empty, "vec_id long, embedding array<double>"))) == plain(empty)


@pytest.mark.parametrize("size", [1e6, 3e6, 4e6])
def test_large_values(spark, size):
    """Scores beyond what doubles hold are exact."""
    rng = random.Random(8)
    rows = [(i, [size + rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(120, [-size] * 8), (200, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(knn.top_k(df, every=10)) == plain(rows, every=10)


def test_too_large(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        knn.top_k(df)


def test_bounds_leave_out(spark, monkeypatch):
    """On clustered vectors the bounds leave few pairs, and lose no neighbour."""
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    for scale in (np.ones((2000, 1)), 0.5 + rng.random((2000, 1))):
        points = (centres[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 12)) * 0.02) * scale
        rows = [(i, x.tolist()) for i, x in enumerate(points)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        told = []
        assert rows_of(knn.top_k(df, told=told)) == plain(rows)
        assert told[0].kept_share < (0.2 if scale.max() == 1 else 0.8)


def test_best_of():
    rng = np.random.default_rng(8)
    for k in (1, 3, 6):
        scores = rng.integers(0, 4, (50, 20))
        found = knn.best_of(scores, k)
        for row, mask in zip(scores.tolist(), found.tolist(), strict=True):
            assert [j for j, m in enumerate(mask) if m] == sorted(sorted(range(20), key=lambda j: (-row[j], j))[:k])
