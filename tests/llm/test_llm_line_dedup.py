"""Spread lines agree with exact counts; documents lose those lines alone."""

from collections import defaultdict

import corpus_pipeline
from cueframe.llm import line_dedup
from cueframe.llm.entry import op9_line_dedup

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def plain(rows, min_sites=10, max_share=0.5):
    """Cleaned text and number of lines removed, in the order of ``rows`` (site, text)."""
    sites, texts = defaultdict(set), defaultdict(set)
    for site, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(SPACES):
                sites[line.strip(SPACES)].add(site)
                texts[line.strip(SPACES)].add(text)
    spread = {line for line in sites if len(sites[line]) >= min_sites and len(texts[line]) >= min_sites}
    out = []
    for _, text in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for x in lines if x.strip(SPACES) not in spread)
        n = sum(x.strip(SPACES) in spread for x in lines)
        out.append((kept, n) if n and len(text) - len(kept) <= max_share * len(text) else (text, 0))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = plain([(r["source"], r["text"]) for r in docs])
    got = op9_line_dedup(spark, SF).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines_removed"]) for r in got] == want


def test_near_threshold(spark):
    """Lines in 8 to 12 sites are told apart exactly; a hot line is in all."""
    rows = []
    for n in range(8, 13):
        rows += [(f"site{s}", f"own words of page {n} {s}\nshared line {n}\n  everywhere  \nmore of the text of this page {n} {s}") for s in range(n)]
    rows += [("one", f"text {i}\nonly one site has this line\nand so on {i}") for i in range(30)]
    rows += [(f"x{i}", "copies of one text\nspread nothing") for i in range(30)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = line_dedup.remove_spread_lines(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines_removed"]) for r in got] == plain(rows)
    assert {r["n_lines_removed"] for r in got} == {0, 1, 2}


def test_edges(spark):
    line = "this menu stands on every site"
    rows = [(i, None if i == 3 else f"s{i}", f"text number {i} goes on for some words more\n{line}\n\n ", f"t{i}", 5) for i in range(12)]
    rows += [(20, "s1", None, "n", 5), (21, "s1", "", "e", 5), (22, "s2", line, "m", 5), (None, "s9", rows[1][2], "i", 5), (1, "s1", rows[1][2], "t1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _t1 string, n_lines_removed int")
    got = line_dedup.remove_spread_lines(docs)
    assert got.columns == docs.columns
    found = sorted((r["_t1"], r["text"], r["n_lines_removed"]) for r in got.where("text is not null").collect())
    want = plain([(r[1], r[2]) for r in rows])
    assert found == sorted((r[3], *w) for r, w in zip(rows, want, strict=True) if w[0] is not None)
    assert got.where("text is null").count() == 1
    assert line_dedup.remove_spread_lines(docs.limit(0)).count() == 0


def test_mostly_boilerplate(spark, tmp_path):
    """The query and the pipeline remove spread lines from documents that hold little else, or nothing."""
    line = "this menu stands on every site and is longer than the rest"
    rows = [(i, f"s{i}", f"text {i}\n{line}", 5) for i in range(12)] + [(20, "s1", line, 5)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: f"text {i}" for i in range(12)} | {20: ""}
    got = op9_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_lines_removed"] == 1 for r in got)
    got = corpus_pipeline.remove_shared_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == {k: (v, len(v)) for k, v in want.items()}
