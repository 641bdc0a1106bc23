"""Main text of pages whose parts are known."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from cueframe.llm import wrapper
from cueframe.llm.entry import op10_html_extraction

SF = "/root/testdata/sf0.001"


def page(title, paragraphs, tail="Read about us and our terms"):
    return (
        f"<!doctype html><html><head><title>{title}</title><style>p {{color:red}}</style></head><body><nav><ul><li>Home<li>News</ul></nav>"
        f"<div class='lead'>Welcome to the daily paper</div><div id=content><h1>{title}</h1>{''.join(f'<p>{p}' for p in paragraphs)}</div>"
        f"<div class='tail'>{tail}</div><script>var x = '<p>no</p>';</script><footer>all rights</footer></body></html>"
    )


def test_template_and_content(spark):
    """What all pages of a host share goes, though no name says what it is."""
    rng = random.Random(10)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(8)) + f" {i} {j}" for j in range(rng.randint(1, 5))]
        rows.append((i, f"https://www.paper.example/{i}", page(f"Title {i}", paragraphs), "x"))
        want[i] = "\n\n".join([f"Title {i}", *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    got = wrapper.main_text(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_rules_of_text(spark):
    html = "<body><article><p>A &amp; B&nbsp;&lt;c&gt;\n  d<br>e &#233;</p><!-- no --><p>  </p><div class='comments'><p>reader</p></div><form>f</form><p>end <b>bo</b>ld</article></body>"
    rows = [(1, "http://one.example/", html), (2, None, html), (3, "u", None), (4, "http://one.example/", ""), (5, None, "<p>open <i>never closed"), (5, None, "<p>open <i>never closed"), (None, "http://", "no tags at all")]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "A & B <c> d e é\n\nend bold"
    assert sorted(((r["page_id"] or 0), r["text"]) for r in got) == [(0, "no tags at all"), (1, text), (2, text), (3, ""), (4, ""), (5, "open never closed"), (5, "open never closed")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrapper.main_text(empty).count() == 0


def test_tree_match():
    a = ("html", (("div.a", ()), ("ul", (("li", ()), ("li", ()))), ("p", ())))
    b = ("html", (("ul", (("li", ()),)), ("p", ()), ("div.a", ())))
    assert wrapper.tree_match(a, a) == (6, list(range(6)))
    assert wrapper.tree_match(a, b)[0] == 4
    assert wrapper.tree_match(a, ("body", ())) == (0, [-1] * 6)


def test_whole_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_html_extraction(spark, SF).collect()
    assert {r["page_id"]: r["url"] for r in got} == pages and len(got) == len(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        assert not any(" ".join(b.split()) != b or not b for b in r["text"].split("\n\n") if r["text"])


def test_long_and_deep(spark):
    deep = "<div>" * 400 + "deep" + "</div>" * 400
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = [(1, "http://a.example/1", deep), (2, "http://a.example/2", long)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "deep", 2: "\n\n".join(["word"] * 20000)}


def test_other_text_in_constant_slot(spark):
    """Of a slot that is constant on nearly all pages, only the constant text goes."""
    rows = [(i, f"https://paper.example/{i}", page(f"Title {i}", [f"own words {i}"], "Notice of the day" if i == 7 else "Read about us")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nown words {i}" + ("\n\nNotice of the day" if i == 7 else "") for i in range(60)}


def test_copies_of_one_article(spark):
    """Copies that differ in a comment alone make no template, and no page loses all it has."""
    def body(i, text):
        return f"<!-- ad {i} --><article><h1>Title {text}</h1><p>the words of {text}</article>"

    rows = [(i, "https://copies.example/", body(i, "one")) for i in range(60)] + [(60 + i, "https://copies.example/", body(i, f"other {i}")) for i in range(2)]
    rows += [(100 + i, "https://same.example/", f"<article><h1>Same</h1></article><div hidden>{i}</div>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "Title one\n\nthe words of one" for i in range(60)} | {60 + i: f"Title other {i}\n\nthe words of other {i}" for i in range(2)}
    assert got == want | {100 + i: "Same" for i in range(30)}


def test_layouts_stubs_and_small_hosts(spark):
    """Template goes from both layouts of a host, from a host with stubs, and from a host of three pages."""
    rows, want = [], {}
    for i in range(50):
        other = f"<body><section class=top>All the news</section><article-box></article-box><div class=story><h2>Head {i}</h2><p>second layout {i}</div><section class=end>Print edition</section>"
        rows.append((i, "https://two.example/", page(f"Title {i}", [f"words {i}"]) if i % 2 else other))
        want[i] = f"Title {i}\n\nwords {i}" if i % 2 else f"Head {i}\n\nsecond layout {i}"
    for i in range(60):
        stub = i >= 30
        rows.append((100 + i, "https://stub.example/", f"<p>error {i}" if stub else page(f"Title {i}", [f"words {i}"])))
        want[100 + i] = f"error {i}" if stub else f"Title {i}\n\nwords {i}"
    for i in range(3):
        rows.append((200 + i, "https://small.example/", page(f"Title {i}", [f"words {i}"])))
        want[200 + i] = f"Title {i}\n\nwords {i}"
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_deep_before_footer(spark):
    """Below any depth, text keeps the slot it stands in."""
    rows = []
    for i in range(25):
        deep = "<div><section>" * 60 + f"<p>deep {i}" + "</section></div>" * 60
        rows.append((i, "https://deep.example/", f"<body>{deep}<h2>Head {i}</h2><table><tr><td>All rights of the house</table><ul><li>own item {i}</ul><h4>Printed daily</h4>"))
    far = "<div>" * 20000 + "<i>" * 20000 + "bottom" + "</i>" * 20000 + "</div>" * 20000
    rows.append((99, "https://far.example/", far))
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"deep {i}\n\nHead {i}\n\nown item {i}" for i in range(25)} | {99: "bottom"}


def test_broken_markup(spark):
    """Comments, declarations and tags without an end, and sections unknown to HTML."""
    cases = {
        "<p>a<!-- unclosed b": "a",
        "<!DOCTYPE html [<!ENTITY x 'y>'> ]><p>x": "x",
        "<![foo[x]]><p>y<![CDATA[q>]]>z<p class='": "yz",
        "<!-->a<!--->b<!-- x --!>c<?php x ?>d": "abcd",
        "<p>1 < 2 &amp; 3 <": "1 < 2 & 3 <",
        "<p>text &am": "text &am",
        "<!": "", "<": "<", "</": "</", "<p": "", "<!DOCTYPE": "",
        "<p>" + "<div>" * 100000 + "deep" + "</div>" * 100000: "deep",
        "<b>" * 100000 + "bold": "bold",
    }
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(df).collect()}
    assert got == dict(enumerate(cases.values()))


def listless(rows, spark, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrapper.main_text(df, hints=wrapper.NO_HINTS, **options)
    return {r["page_id"]: r["text"] for r in found.collect()}


def named_page(i, turn):
    menu = "".join(f"<li>{x}" for x in ("Home", "Sports", "Weather"))
    return (
        f"<body><div class=navbar><ul>{menu}</ul></div><div role=banner>The paper</div><div class=promo>Offer {turn}</div><div class=story><h1>Title {i}</h1><p>words of {i} and more words"
        f"</div><div class=comments><h3>Comments</h3></div><div id=footer>All rights reserved</div>"
    )


def test_template_alone(spark):
    """Without any list of names, roles or elements, alignment and aggregation find the
    template of hosts whose pages share one; without them, no page comes right."""
    rows = [(i, f"https://h{i % 2}.example/{i}", named_page(i, i % 7)) for i in range(120)]
    want = {i: f"Title {i}\n\nwords of {i} and more words" for i in range(120)}
    assert listless(rows, spark) == want
    off = listless(rows, spark, least_pages=10**9, least_turns=10**9)
    assert sum(off[i] != want[i] for i in want) == 120
    fixed = listless(rows, spark, least_turns=10**9)
    assert all(fixed[i] == f"Offer {i % 7}\n\n{want[i]}" for i in want)


def test_near_copies_take_no_turns(spark):
    """What near copies share is no notice that a slot shows by turns: pages
    with one longest paragraph count once."""
    bodies = [" ".join(f"word{j}x{k}" for j in range(60)) for k in range(4)]
    rows = [(i, "https://copies.example/", f"<h1>Title {i % 4}</h1><p>{bodies[i % 4]}<p>Changed {i}") for i in range(80)]
    assert listless(rows, spark) == {i: f"Title {i % 4}\n\n{bodies[i % 4]}\n\nChanged {i}" for i in range(80)}


def test_template_of_whole_table(spark):
    """Of pages as they come, with no hint taken: on the host with pages enough
    for its changing menus, notices and footers to come again, the method alone
    gives the main text; without it no page comes right."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want, got, off = (
        {r["page_id"]: r["text"] for r in wrapper.main_text(pages, **o).select("page_id", "text").collect()}
        for o in ({}, {"hints": wrapper.NO_HINTS}, {"hints": wrapper.NO_HINTS, "least_pages": 10**9, "least_turns": 10**9})
    )
    host = pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("h")).count().agg(F.max("count")).first()[0]
    right = {i for i in want if got[i] == want[i]}
    assert len(right) > 0.95 * host and not any(off[i] == want[i] for i in want)
    assert all(got[i] in (off[i], want[i]) for i in want)


def plain_match(a, b):
    """Simple tree matching as it is defined, by a table for every pair of nodes."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, c in enumerate(a[1]):
        for j, d in enumerate(b[1]):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain_match(c, d))
    return table[-1][-1] + 1


def random_tree(rnd, depth):
    return (rnd.choice("pqr"), tuple(random_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4 if depth else 0))))


def test_tree_match_against_tables():
    rnd = random.Random(8)
    for _ in range(600):
        a, b = random_tree(rnd, 3), random_tree(rnd, 3)
        b = ("p", a[1][: rnd.randint(0, 4)] + b[1]) if rnd.random() < 0.5 else b
        score, partner = wrapper.tree_match(a, b)
        assert score == plain_match(a, b)
        (x, below), (y, beneath) = wrapper._numbered(a), wrapper._numbered(b)
        up = {c: p for p, kids in enumerate(below) for c in kids}
        over = {c: p for p, kids in enumerate(beneath) for c in kids}
        met = [(i, j) for i, j in enumerate(partner) if j >= 0]
        assert len(met) == score and len({j for _, j in met}) == score
        for i, j in met:
            assert x[i] == y[j] and (i == 0 or partner[up[i]] == over[j])
        for kids in below:
            found = [partner[k] for k in kids if partner[k] >= 0]
            assert found == sorted(found)


@pytest.mark.parametrize("unit", ["<dt>t{0}</dt><dd>d{0}</dd>", '<tr class="odd"><td>{0}</td><th>x</th><td>y</td></tr><tr class="even"><td>{0}</td></tr>', "<div>a{0}</div><p>b</p><h2>c</h2>", '<div id="n{0}"><p>x</p></div>', '<div class="c{1}"><p>x</p><ul><li>y</ul></div><p>z</p>'])
def test_pages_of_many_unlike_siblings(unit):
    """Long lists of terms, striped tables and numbered parts take linear memory and time."""
    pages = [f"<html><body><div>{''.join(unit.format(i, i % 70) for i in range(n))}</div><footer>f</footer></body></html>" for n in (4000, 3900)]
    tracemalloc.start()
    started = time.monotonic()
    rows = wrapper.align(pages[0], pages[1], wrapper.NO_HINTS)
    spent, (_, peak) = time.monotonic() - started, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(rows) >= 4000 and peak < 100 << 20 and spent < 60


def test_folds_number_blocks_as_trees():
    """Slots of blocks are numbers of the folded tree, also where many unlike siblings are folded by key."""
    html = "<body>" + "".join(f"<div>a{i}</div><p>b{i}</p>" for i in range(100)) + "<section><p>x</p></section><p>y</p><ul><li>z</ul></body>"
    root = wrapper.parse(html, wrapper.NO_HINTS)
    keys, _ = wrapper._numbered(wrapper.folded(root))
    found = wrapper.blocks(root, list(range(len(keys))), frozenset())
    assert {t: keys[s] for s, t in found if not t[1:]} == {"x": "p", "y": "p", "z": "li"} and all(keys[s] == ("div" if t[0] == "a" else "p") for s, t in found if t[1:])
    assert keys.count("div") == 1 and keys.count("p") == 2
