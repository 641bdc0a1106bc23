"""Near-duplicate components agree with all pairs compared."""

import random
import re

import pytest
import xxhash

from cueframe.llm import simhash
from cueframe.llm.components import connected_components
from cueframe.llm.entry import op4_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def all_pairs(fps, distance=4):
    distinct = sorted(set(fps))
    return closure(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= distance])


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = all_pairs(fps.values())
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(roots[f], i)
    rows = op4_simhash_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}
    assert len(rows) == len(texts)


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 6])
def test_links_close_to_all_pairs(spark, distance):
    """Chains and clouds of fingerprints, one bucket over several blocks."""
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 1)))
    hub = rng.getrandbits(64)
    fps |= {hub ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), distance, block=16).collect()
    mask = (1 << 64) - 1
    edges = [(r["a"] & mask, r["b"] & mask) for r in got]
    assert all((a ^ b).bit_count() <= distance for a, b in edges)
    assert closure(fps, edges) == all_pairs(fps, distance)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 500)] + [(600, i) for i in range(601, 700)] + [(7, 7)]
    want = closure({n for e in edges for n in e}, edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    joined = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in got} == {n: want[n] for n in joined}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


SCHEMA = "doc_id long, text string, _k1 string, fp int"


def test_edges(spark):
    long = " ".join(str(i) for i in range(30000))
    rows = [(3, None, "x", 1), (2, "", "x", 1), (9, " \t\n", "x", 1), (5, long, "y", 1), (4, long, "y", 1), (4, long, "y", 1), (None, "one two", "z", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (2, 2), (3, 2), (4, 4), (4, 4), (5, 4), (9, 2)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_k1"], r["fp"]) for r in kept.collect()) == [(0, "z", 1), (2, "x", 1), (4, "y", 1)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_hot_bucket_in_blocks(spark):
    """A bucket of many blocks, each pair of which is verified once."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(40, 64)) ^ (1 << rng.randrange(40, 64)) ^ (1 << rng.randrange(40, 64)) for _ in range(300)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {frozenset((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)) for r in simhash.links(df, block=16).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in map(tuple, found):
        assert bin(a ^ b).count("1") <= 4
        parent[root(a)] = root(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                assert root(a) == root(b)
