"""Edits of cue trees agree with a plain tree of lists, and stay well formed."""

import random

import pytest
from pyspark.sql import functions as F

from cueframe.functions import trees, vtt_text


def plain(nodes):
    """Nested lists ``[shown, tag, children]`` of a node array, and each node by its number."""
    top, by_number = [], []
    for i, n in enumerate(nodes):
        assert n["node_id"] == i
        made = [n["text"] if n["kind"] == "Text" else n["tag"], n["kind"], []]
        parent = n["parent_id"]
        assert n["depth"] == (0 if parent is None else nodes[parent]["depth"] + 1) and (parent is None or parent < i)
        (top if parent is None else by_number[parent][2]).append(made)
        by_number.append(made)
    return top, by_number


def languages_of(nodes):
    found = []
    for n in nodes:
        around = None if n["parent_id"] is None else found[n["parent_id"]]
        found.append((n["annotation"] or "") if n["tag"] == "lang" else around)
    return found


BODIES = ["", "a", "<b>a<i>x</i>c</b>d<lang en><u>y</u></lang>", "<lang fr>a<lang en>b</lang><b>c</b></lang><b></b>", "<b><i><u>x</u>y</i>z</b><v A>w<00:01.000>q</v>" * 3]


@pytest.fixture(scope="module")
def rows(spark):
    """Trees with places to edit, some of them not there."""
    rnd = random.Random(4)
    data = [(i % len(BODIES), BODIES[i % len(BODIES)], rnd.randint(-1, 9), rnd.choice([None, *range(9)]), rnd.randint(-1, 4), rnd.randint(0, 3)) for i in range(120)]
    made = spark.createDataFrame(data, "k int, body string, at int, parent int, place int, n int").select("*", vtt_text.tree(F.col("body"))["nodes"].alias("nodes"))
    return made.cache()


def below(nodes, i):
    while i is not None:
        yield i
        i = nodes[i]["parent_id"]


def checked(found, change):
    some = False
    for r in found:
        top, by_number = plain(r["nodes"])
        change(r, top, by_number)
        after, _ = plain(r["after"])
        assert after == top, r
        assert [n["lang"] for n in r["after"]] == languages_of(r["after"])
        some = some or r["after"] != r["nodes"]
    assert some


NEW = [["new", "Text", []], ["lang", "Tag", [["in", "Text", []]]]]


def literal():
    return trees.forest(trees.text("new"), trees.tag("lang", trees.text("in"), annotation="de"))


def test_spliced(rows):
    found = rows.select("*", trees.spliced(F.col("nodes"), F.col("parent"), F.col("place"), F.col("n"), literal()).alias("after")).collect()

    def change(r, top, by_number):
        if r["parent"] is None:
            children = top
        elif r["parent"] < len(by_number) and by_number[r["parent"]][1] == "Tag":
            children = by_number[r["parent"]][2]
        else:
            return
        first = max(r["place"], 0)
        children[first : first + r["n"]] = NEW

    checked(found, change)


def test_removed_and_replaced(rows):
    for new, expr in (([], trees.removed(F.col("nodes"), F.col("at"))), (NEW, trees.replaced(F.col("nodes"), F.col("at"), literal()))):

        def change(r, top, by_number, new=new):
            if 0 <= r["at"] < len(by_number):
                parent = r["nodes"][r["at"]]["parent_id"]
                children = top if parent is None else by_number[parent][2]
                where = next(i for i, c in enumerate(children) if c is by_number[r["at"]])
                children[where : where + 1] = new

        checked(rows.select("*", expr.alias("after")).collect(), change)


def test_moved(rows):
    found = rows.select("*", trees.moved(F.col("nodes"), F.col("at"), F.col("parent"), F.col("place")).alias("after")).collect()

    def change(r, top, by_number):
        at, parent = r["at"], r["parent"]
        if not 0 <= at < len(by_number) or (parent is not None and (parent >= len(by_number) or by_number[parent][1] != "Tag" or at in below(r["nodes"], parent))):
            return
        old = r["nodes"][at]["parent_id"]
        children = top if old is None else by_number[old][2]
        children[:] = [c for c in children if c is not by_number[at]]
        (top if parent is None else by_number[parent][2]).insert(max(r["place"], 0), by_number[at])

    checked(found, change)


def test_wrapped_and_taken(rows):
    found = rows.select("*", trees.wrapped(F.col("nodes"), F.col("at"), "lang", annotation="nl").alias("after"), trees.subtree(F.col("nodes"), F.col("at")).alias("sub"), trees.children(F.col("nodes"), F.col("parent")).alias("kids")).collect()

    def change(r, top, by_number):
        if 0 <= r["at"] < len(by_number):
            node = by_number[r["at"]]
            node[:] = ["lang", "Tag", [list(node)]]

    checked(found, change)
    for r in found:
        top, by_number = plain(r["nodes"])
        assert plain(r["sub"])[0] == ([by_number[r["at"]]] if 0 <= r["at"] < len(by_number) else [])
        assert plain(r["kids"])[0] == (top if r["parent"] is None else by_number[r["parent"]][2] if r["parent"] < len(by_number) else [])


def test_intervals(rows):
    for r in rows.select("nodes", trees.ends(F.col("nodes")).alias("ends")).collect():
        for i, end in enumerate(r["ends"]):
            assert end == 1 + max(j for j in range(len(r["nodes"])) if i in below(r["nodes"], j))


def test_literals_and_nulls(spark):
    made = trees.forest(trees.tag("b", trees.text("a &amp; b"), trees.tag("i", trees.text("x"), classes="k.l")), trees.text("c"))
    row = spark.range(1).select(vtt_text.serialize(made).alias("text"), vtt_text.serialize(trees.appended(made, 1, made)).alias("same"), trees.removed(F.lit(None).cast(trees.FOREST), 0).alias("none")).first()
    assert row["text"] == row["same"] == "<b>a & b<i.k.l>x</i></b>c" and row["none"] is None
    with pytest.raises(ValueError, match="no cue tag"):
        trees.tag("q")


def test_long_cue_in_one_select(spark):
    """A megabyte of cue text is read and written in one expression, in time that grows with it."""
    unit = "<b>bold</b><i>x<u>y</u></i>some longer text that is here &amp; there<00:01.000>"
    row = spark.createDataFrame([(unit * 13000,)], "body string").select(vtt_text.serialize(vtt_text.tree(F.col("body"))["nodes"]).alias("t")).first()
    assert row["t"] == unit.replace("&amp;", "&").replace("<00:", "<00:") * 13000
