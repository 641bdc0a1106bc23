"""Overlapping intervals agree with all pairs, whatever their lengths."""

import random

from pyspark.sql import functions as F

from cueframe.operators.overlaps import MOST, level, overlaps


def test_any_lengths(spark):
    rnd = random.Random(6)

    def some(n):
        rows = []
        for i in range(n):
            a = rnd.choice([rnd.randint(-50, 50), rnd.randint(-(10**12), 10**12), 0, 1 << 20])
            rows.append((i, rnd.choice(["x", "y", None]), a, a + rnd.choice([0, 1, 2, 3, 8, 9, rnd.randint(-5, 100), 1 << rnd.randint(0, 50), 1 << 60]), 1))
        return rows + [(n, "x", None, 3, 1), (n + 1, "x", 3, None, 1), rows[0], rows[0]]

    left, right = some(150), some(120)
    columns = "id int, k string, start long, end long, _level int"
    got = overlaps(spark.createDataFrame(left, columns).drop("_level"), spark.createDataFrame(right, columns).drop("_level"), ["k"])
    assert got.columns == ["id", "k", "start", "end", "other_id", "other_start", "other_end"]
    want = []
    for i, k, a, b, _ in left:
        for j, m, c, d, _ in right:
            if None not in (k, a, b, c, d) and k == m and a < b and c < d and a < d and c < b:
                want.append((i, k, a, b, j, c, d))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_levels_and_ends(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 1 << 40, (1 << 40) + 1)], "n long").select("n", level(F.col("n")).alias("l")).collect()
    assert [r["l"] for r in rows] == [0, 1, 2, 2, 3, 40, 41]
    far = spark.createDataFrame([(1, "0", str(10**25)), (2, "5", "6"), (3, str(-(10**25)), "1")], "id int, start string, end string").selectExpr("id", "1 as k", "cast(start as decimal(38,0)) start", "cast(end as decimal(38,0)) end")
    assert sorted((r["id"], r["other_id"]) for r in overlaps(far, far, ["k"]).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 3)]
    assert MOST * 4 < 2**63 + 1 and overlaps(far.limit(0), far, ["k"]).count() == 0
