"""Targets agree with a plain solution; what is taken comes near them."""

import re
from collections import defaultdict

import pytest

from cueframe.llm import mixing
from cueframe.llm.entry import op5_source_mixing

SF = "/root/testdata/sf0.001"


def plain_targets(totals, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(totals.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= cap * totals[s]}
        if not over:
            break
        for s in over:
            out[s] = cap * totals[s]
            left -= out[s]
        open_ -= over
    return out | {s: w[s] * level for s in open_}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def holds(rows, totals):
    targets = plain_targets(totals)
    taken = defaultdict(int)
    least = defaultdict(lambda: 1 << 60)
    for r in rows:
        assert r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        if r["size"]:
            least[r["source"]] = min(least[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(least[s], 0.01 * t) or not totals[s]


def test_whole_table(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    totals = defaultdict(int)
    for r in texts:
        totals[r["source"]] += size(r["text"])
    first = op5_source_mixing(spark, SF).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["size"]) for r in first] == sorted((r["doc_id"], size(r["text"])) for r in texts)
    holds(first, totals)
    assert op5_source_mixing(spark, SF).orderBy("doc_id").collect() == first


def test_one_source_holds_a_third(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", "w " * (i % 50)) for i in range(1500)]
    rows += [(9000 + i, None, "w " * 7) for i in range(30)] + [(9100, "empty", None), (None, "s1", "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    totals = defaultdict(int)
    for _, s, t in rows:
        totals[s] += size(t)
    got = mixing.mix_sources(docs).selectExpr("*", "copies * size as taken").collect()
    assert len(got) == len(rows)
    holds(got, totals)


def test_rows_taken(spark):
    rows = [(1, "a", "x y z", "r", 1), (1, "a", "x y z", "r", 1), (2, "b", "p q", "s", 2), (3, None, None, "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _row string, copies int")
    counts = mixing.mix_sources(docs).groupBy("doc_id").sum("copies").collect()
    got = mixing.taken(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in counts if r[1]}
    assert all(r["_row"] == {1: "r", 2: "s", 3: "t"}[r["doc_id"]] for r in got.collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0
