"""Helpers of the corpus operators."""

import pytest
from pyspark.sql import functions as F

from cueframe.llm import common


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("most", [0, 1 << 19])
def test_hot_join(spark, monkeypatch, how, most):
    """Whether broadcast whole, or hot keys only, the rows are those of a plain join."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.lit("x").alias("n_"))
    right = left.where("k is not null and k % 2 = 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = common.hot_join(left, right, ["k"], "n", 3000, how)
    want = left.join(right.drop("n"), ["k"], how)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_lowest(spark):
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h"))
    want = sorted((r["h"], r["id"]) for r in rows.collect())[:5]
    assert [(r["h"], r["id"]) for r in common.lowest(rows, "h", 5).collect()] == want


def test_shared_dir_of_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
