"""The pipeline's stages, one by one, against brute force on their own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from cueframe.llm.entry import ranks_path
from test_llm_line_dedup import plain as plain_lines
from test_llm_simhash import all_pairs, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect(), docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (a, b), (c, d), (e, f), (g, h), (i, j) = seen.values()

    assert 0.8 * len(a) <= len(b) <= len(a) and not Counter(b) - Counter(a)

    want = plain_lines([(r["source"], r["text"]) for r in c])
    assert Counter((r["doc_id"], t) for r, (t, _) in zip(c, want, strict=True)) == Counter((r["doc_id"], r["text"]) for r in d)
    assert all(r["n_chars"] == len(r["text"]) for r in d)

    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in e}
    roots = all_pairs(fps.values())
    assert sorted(r["doc_id"] for r in f) == sorted({roots[v]: k for k, v in sorted(fps.items(), reverse=True)}.values())

    assert all(1 <= n <= 2 for n in Counter(h).values()) and not set(h) - set(g)

    assert len(j) == len(i)
    assert Counter(r["decoded_sha256"] for r in j) == Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in i)
    assert all(r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["n_tokens"] * 4 == len(r["ids"]) for r in j)
    assert ranks_path()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
