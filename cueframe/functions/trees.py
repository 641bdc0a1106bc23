"""Edits of cue trees: children set, inserted, removed, replaced and moved.

A tree is an array of nodes in document order, so a subtree is an interval of
it.  An edit puts intervals of the tree, and a forest, side by side anew: each
interval is renumbered by how far it moved, and its depth by where it went.
Forests, the arguments and results here, are trees whose nodes are to go below
some node.  Time is linear in the nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueframe.functions import vtt_text
from cueframe.functions.arrays import let, running
from cueframe.functions.vtt_text import NODE, normalize_annotation

FOREST = f"array<{NODE}>"
TAG_NAMES = ("ruby", "rt", "lang", "b", "i", "u", "c", "v")
_ALL = 1 << 30


def _column(value: Column | str | int | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class Literal:
    """A node to be made, with the nodes below it."""

    kind: str
    tag: str | None = None
    classes: Column | str | None = None
    annotation: Column | str | None = None
    text: Column | str | None = None
    ts: Column | None = None
    children: tuple[Literal, ...] = ()


def text(raw: Column | str) -> Literal:
    """A text, with character references as they stand in a file."""
    return Literal("Text", text=raw)


def stamp(ts: Column) -> Literal:
    """A timestamp tag."""
    return Literal("Timestamp", ts=ts)


def tag(name: str, *children: Literal, classes: Column | str = "", annotation: Column | str | None = None) -> Literal:
    """A tag over its children, in order; classes and annotation as they stand in a file."""
    if name not in TAG_NAMES:
        raise ValueError(f"no cue tag is called {name}")
    return Literal("Tag", name, classes, annotation, children=children)


def forest(*literals: Literal) -> Column:
    """The forest of literals side by side: a tree of its own, or to be put into one."""
    made: list[Column] = []

    def put(one: Literal, parent: int | None, depth: int) -> None:
        number = len(made)
        fields = {"node_id": number, "parent_id": parent, "depth": depth, "kind": one.kind, "tag": one.tag, "classes": one.classes, "annotation": one.annotation, "text": one.text, "ts": one.ts, "lang": None}
        made.append(F.struct(*(_column(value).alias(name) for name, value in fields.items())).cast(NODE))
        for child in one.children:
            put(child, number, depth + 1)

    for one in literals:
        put(one, None, 0)
    plain = F.array(*made).cast(FOREST)
    return languages(plain) if any(_speaks(one) for one in literals) else plain


def _speaks(one: Literal) -> bool:
    return one.tag == "lang" or any(map(_speaks, one.children))


def languages(nodes: Column) -> Column:
    """Nodes with ``lang`` as the tags around them now say."""

    def own(langs: Column, n: Column) -> Column:
        named = (n["kind"] == "Tag") & (n["tag"] == "lang")
        return F.when(named, F.coalesce(normalize_annotation(n["annotation"]), F.lit(""))).otherwise(F.get(langs, n["depth"] - 1))

    def step(langs: Column, n: Column) -> Column:
        return F.concat(F.slice(langs, F.lit(1), n["depth"]), F.array(own(langs, n)))

    def again(ns: Column) -> Column:
        return running(ns, F.array().cast("array<string>"), step, "array<string>", lambda langs, n: n.withField("lang", own(langs, n)), NODE)

    # Without a lang tag there is nothing to find out.
    return let(nodes, lambda ns: F.when(F.exists(ns, lambda n: F.coalesce(n["tag"] == "lang", F.lit(False)) | n["lang"].isNotNull()), again(ns)).otherwise(ns))


def ends(nodes: Column) -> Column:
    """For each node the number behind its last descendant: with its own
    number, the interval that it spans."""

    def step(nearest: Column, n: Column) -> Column:
        # By depth, the next node that is no deeper; null where there is none.
        kept = F.slice(nearest, F.lit(1), n["depth"])
        return F.concat(kept, F.array_repeat(F.try_element_at(nearest, F.lit(-1)), n["depth"] - F.size(kept)), F.array(n["node_id"]))

    def whole(back: Column) -> Column:
        return running(back, F.array().cast("array<int>"), step, "array<int>", lambda nearest, n: F.coalesce(F.get(nearest, F.least(n["depth"], F.size(nearest) - 1)), F.size(back)), "int")

    return F.reverse(let(F.reverse(nodes), whole))


def _end(nodes: Column, at: Column) -> Column:
    """The number behind the last descendant of one node."""
    behind = F.transform(F.slice(nodes, at + 2, F.size(nodes)), lambda n: n["depth"] <= F.get(nodes, at)["depth"])
    found = F.array_position(behind, True).cast("int")
    return F.when(found > 0, at + found).otherwise(F.size(nodes))


def _part(nodes: Column, start: Column, stop: Column, by: Column | int = 0, deeper: Column | int = 0, roots: Column | None = None, kept: Column | None = None) -> Column:
    """The nodes from ``start`` to ``stop`` (left out), numbers raised ``by``
    and depths by ``deeper``.  Parents within go along; others stay, or become
    ``roots`` where a struct of one is given; those from ``kept`` on go along too."""

    def one(n: Column) -> Column:
        goes = n["parent_id"] >= (start if kept is None else kept)
        parent = F.when(goes, n["parent_id"] + by).otherwise(n["parent_id"] if roots is None else roots)
        return n.withField("node_id", n["node_id"] + by).withField("parent_id", parent.cast("int")).withField("depth", n["depth"] + deeper).cast(NODE)

    return F.transform(F.slice(nodes, start + 1, stop - start), one)


def _with(bound: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        bound = bound.withField(name, value)
    return bound


def _struct(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items()))


def _no_parent() -> Column:
    return F.lit(None).cast("int")


def _taken(nodes: Column, at: Column | int | None, with_root: bool) -> Column:
    skip = 0 if with_root else 1

    def part(b: Column) -> Column:
        first = b["a"] + skip
        there = languages(_part(b["n"], first, _end(b["n"], b["a"]), -first, -F.get(b["n"], b["a"])["depth"] - skip, _no_parent(), first))
        none = F.array().cast(FOREST)
        return F.when(F.get(b["n"], b["a"]).isNotNull(), there).otherwise(none if with_root else F.when(b["a"].isNull(), b["n"]).otherwise(none))

    return let(_struct(n=nodes, a=_column(at).cast("int")), part)


def subtree(nodes: Column, at: Column | int) -> Column:
    """Node number ``at`` with all below it, as a forest; empty if there is no such node."""
    return _taken(nodes, at, True)


def children(nodes: Column, at: Column | int | None) -> Column:
    """What lies below node number ``at``, or everything for null, as a forest."""
    return _taken(nodes, at, False)


def _exchanged(b: Column) -> Column:
    """``b.n`` with the nodes from ``b.start`` to ``b.stop`` (left out), whole
    subtrees below ``b.p``, replaced by the forest ``b.f``."""
    n, zero = b["n"], F.lit(0)
    depth = F.coalesce(F.get(n, b["p"])["depth"] + 1, zero)
    new = _part(b["f"], zero, F.size(b["f"]), b["start"], depth, b["p"])
    behind = _part(n, b["stop"], F.size(n), F.size(b["f"]) - (b["stop"] - b["start"]))
    return languages(F.concat(F.slice(n, F.lit(1), b["start"]), new, behind))


def spliced(nodes: Column, parent: Column | int | None, place: Column | int, count: Column | int, new: Column) -> Column:
    """Nodes with ``count`` children of node number ``parent`` (null: of the
    top) from child number ``place`` on replaced by the forest ``new``.

    Places and counts are taken within what there is, and negative or null
    ones as 0.  Where ``parent`` is no tag of the tree, nothing changes.  The
    languages of all nodes are those that the tags around them name afterwards.
    """
    whole = lambda value: F.greatest(F.coalesce(_column(value).cast("int"), F.lit(0)), F.lit(0))

    def cut(b: Column) -> Column:
        def at(child: Column) -> Column:
            return F.coalesce(F.get(b["firsts"], child), b["end"])

        first = F.least(b["place"], F.size(b["firsts"]))
        # No more children than there are, so that the sum cannot overflow.
        return _with(b, start=at(first), stop=at(first + F.least(b["count"], F.size(b["firsts"]))))

    bound = _struct(n=nodes, f=new, p=_column(parent).cast("int"), place=whole(place), count=whole(count))
    fits = lambda b: b["p"].isNull() | F.coalesce(F.get(b["n"], b["p"])["kind"] == "Tag", F.lit(False))
    spans = lambda b: _with(
        b,
        firsts=F.transform(F.filter(b["n"], lambda n: n["parent_id"].eqNullSafe(b["p"])), lambda n: n["node_id"]),
        end=F.when(b["p"].isNull(), F.size(b["n"])).otherwise(_end(b["n"], b["p"])),
    )
    return let(bound, lambda b: F.when(fits(b), let(let(spans(b), cut), _exchanged)).otherwise(b["n"]))


def with_children(nodes: Column, parent: Column | int | None, new: Column) -> Column:
    """Nodes with the forest ``new`` in place of all children of a node."""
    return spliced(nodes, parent, 0, _ALL, new)


def inserted(nodes: Column, parent: Column | int | None, place: Column | int, new: Column) -> Column:
    """Nodes with a forest before child number ``place`` of a node."""
    return spliced(nodes, parent, place, 0, new)


def appended(nodes: Column, parent: Column | int | None, new: Column) -> Column:
    """Nodes with a forest behind the last child of a node."""
    return spliced(nodes, parent, _ALL, 0, new)


def replaced(nodes: Column, at: Column | int, new: Column) -> Column:
    """Nodes with a forest in place of node number ``at`` and all below it; no such node: no change."""
    bound = _struct(n=nodes, f=new, start=_column(at).cast("int"))
    spans = lambda b: _with(b, stop=_end(b["n"], b["start"]), p=F.get(b["n"], b["start"])["parent_id"])
    return let(bound, lambda b: F.when(F.get(b["n"], b["start"]).isNotNull(), let(spans(b), _exchanged)).otherwise(b["n"]))


def removed(nodes: Column, at: Column | int) -> Column:
    """Nodes without node number ``at`` and all below it."""
    return replaced(nodes, at, F.array().cast(FOREST))


def wrapped(nodes: Column, at: Column | int, name: str, classes: Column | str = "", annotation: Column | str | None = None) -> Column:
    """Nodes with a new tag around node number ``at`` and all below it."""

    def around(b: Column) -> Column:
        n, a, one = b["n"], b["a"], F.lit(1)
        old = F.get(n, a)
        head = old.withField("kind", F.lit("Tag")).withField("tag", F.lit(name)).withField("classes", _column(classes)).withField("annotation", _column(annotation).cast("string")).withField("text", F.lit(None)).withField("ts", F.lit(None)).cast(NODE)
        below = _part(n, a, b["end"], one, one, a, a)
        return languages(F.concat(F.slice(n, one, a), F.array(head), below, _part(n, b["end"], F.size(n), one, 0, None, b["end"])))

    if name not in TAG_NAMES:
        raise ValueError(f"no cue tag is called {name}")
    bound = _struct(n=nodes, a=_column(at).cast("int"))
    return let(bound, lambda b: F.when(F.get(b["n"], b["a"]).isNotNull(), let(_with(b, end=_end(b["n"], b["a"])), around)).otherwise(b["n"]))


def moved(nodes: Column, at: Column | int, parent: Column | int | None, place: Column | int) -> Column:
    """Nodes with node number ``at``, and all below it, as child number
    ``place`` of node number ``parent``, counted without the node itself.
    Into itself, or where either is no such node: no change."""

    def spans(b: Column) -> Column:
        n, p = b["n"], b["p"]
        firsts = F.transform(F.filter(n, lambda x: x["parent_id"].eqNullSafe(p) & (x["node_id"] != b["a"])), lambda x: x["node_id"])
        return _with(b, stop=_end(n, b["a"]), firsts=firsts, behind=F.when(p.isNull(), F.size(n)).otherwise(_end(n, p)), size=F.size(n))

    def placed(b: Column) -> Column:
        n, a, stop, to = b["n"], b["a"], b["stop"], b["to"]
        deeper = F.coalesce(F.get(n, b["p"])["depth"] + 1, F.lit(0)) - F.get(n, a)["depth"]
        long = stop - a

        # Numbers between the two places move by the length of what went past them.
        def others(start: Column, end: Column, by: Column) -> Column:
            def number(i: Column) -> Column:
                return i + F.when((to >= stop) & (i >= stop) & (i < to), -long).when((to <= a) & (i >= to) & (i < a), long).otherwise(0)

            return F.transform(F.slice(n, start + 1, F.greatest(end - start, F.lit(0))), lambda x: x.withField("node_id", x["node_id"] + by).withField("parent_id", number(x["parent_id"])).cast(NODE))

        late = to >= stop
        went = F.when(late, to - long).otherwise(to) - a
        target = F.when(b["p"] >= stop, F.when(late, b["p"] - long).otherwise(b["p"])).otherwise(b["p"])
        itself = _part(n, a, stop, went, deeper, target)
        zero = F.lit(0)
        forward = F.concat(others(zero, a, zero), others(stop, to, -long), itself, others(to, b["size"], zero))
        back = F.concat(others(zero, to, zero), itself, others(to, a, long), others(stop, b["size"], zero))
        return languages(F.when(late, forward).otherwise(back))

    bound = _struct(n=nodes, a=_column(at).cast("int"), p=_column(parent).cast("int"), place=F.greatest(F.coalesce(_column(place).cast("int"), F.lit(0)), F.lit(0)))

    def whole(b: Column) -> Column:
        n, a, p = b["n"], b["a"], b["p"]
        fits = F.get(n, a).isNotNull() & (p.isNull() | (F.coalesce(F.get(n, p)["kind"] == "Tag", F.lit(False)) & ((p < a) | (p >= b["stop"]))))
        target = _with(b, to=F.coalesce(F.get(b["firsts"], b["place"]), b["behind"]))
        return F.when(fits, let(target, placed)).otherwise(n)

    return let(let(bound, spans), whole)


def edit(nodes: Column, where: Callable[[Column], Column], **fields: Callable[[Column], Column]) -> Column:
    """As ``vtt_text.edit``, with the languages that follow from it."""
    return languages(vtt_text.edit(nodes, where, **fields))
