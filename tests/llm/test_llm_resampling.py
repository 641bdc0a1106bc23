"""Resampling agrees with a plain version in loops."""

import hashlib
import io
import math
import re
import zlib
from contextlib import redirect_stdout

import pytest

from cueframe.llm import resampling
from cueframe.llm.entry import op12_importance_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def counts(texts, buckets):
    out = [0] * buckets
    for text in texts:
        for f in features(text)[1]:
            out[zlib.crc32(f.encode()) % buckets] += 1
    return out


def brute(docs, target, percent=5, seed=42, least=20, buckets=10000):
    s, t = counts([d[1] for d in docs], buckets), counts(target, buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((n >= least, doc_id, len(found), weight, score))
    fits = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = len(fits) * percent // 100
    out = [(*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(fits)]
    return sorted(out + [(*r[1:], None) for r in rows if not r[0]], key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op12_importance_resampling(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert rows_of(got) == brute(docs, target)


TEXTS = [None, "", " \n!?", "One", "one TWO", "Ärger ÄRGER ärger Ⅷ İx\x80y", "a1b2-c3_d4", "日本 語 の テキスト", " ".join(f"w{i % 50}" for i in range(400)), "x y z " * 1000, "é" * 70000]


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_edges(spark, percent):
    """Nulls, blank and very long texts, repeated rows, ties, and columns that clash."""
    docs = [(i, text) for i, text in enumerate(TEXTS)] + [(None, TEXTS[8]), (8, TEXTS[8]), (8, TEXTS[8]), (None, None), (None, None), (3, TEXTS[9])]
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, id int, rank int, _chunk int").repartition(3)
    target = spark.createDataFrame([("w1 w2 w3 x",), (None,), ("ärger one",)], "text string")
    got = resampling.resample(table, target, percent=percent, least_words=2, buckets=97)
    assert rows_of(got) == brute(docs, ["w1 w2 w3 x", None, "ärger one"], percent, least=2, buckets=97)


def test_empty(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert rows_of(resampling.resample(some, target, least_words=1)) == brute([(1, "a b c"), (2, None)], [], least=1)


@pytest.mark.parametrize("n", range(1, 7))
def test_features_across_chunks(spark, n, monkeypatch):
    """Arrays of few words give the features of the whole."""
    monkeypatch.setattr(resampling, "CHUNK", n)
    texts = [" ".join("abcdefghij"[:k]) for k in range(11)]
    found = resampling.bucket_counts(spark.createDataFrame([(t,) for t in texts], "text string"), buckets=1 << 30).collect()
    want = {}
    for text in texts:
        for f in features(text)[1]:
            key = zlib.crc32(f.encode()) % (1 << 30)
            want[key] = want.get(key, 0) + 1
    assert {r["bucket"]: r["n"] for r in found} == want


def test_plan(spark):
    """Only sums, sorted rows and one gain per bucket move; no Python."""
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    out = io.StringIO()
    with redirect_stdout(out):
        resampling.weights(docs, resampling.gains(docs, target)).explain()
    plan = out.getvalue()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum(gain" in plan and "SortMergeJoin" not in plan
