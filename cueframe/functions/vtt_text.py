"""WebVTT cue text: tokens, character references, annotations, and trees.

Trees are flat: an array of nodes in document order, each with its parent's
number.  A running fold over the tokens carries what is open; each token and
the state before it then make a node.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueframe.functions import times
from cueframe.functions.arrays import let, running

TAGS = r"(?:ruby|rt|lang|[biucv])"
END = rf"</{TAGS}>"
START = rf"<{TAGS}(?:[. \t\n\f][^>]*)?"
STAMP = r"<(?:[0-9]+:)?[0-5][0-9]:[0-5][0-9]\.[0-9]{3}>"
#: An unterminated timestamp needs hours of two digits at least, and 29 characters at most.
LOOSE_STAMP = r"<(?:[0-9]{2,19}:)?[0-5][0-9]:[0-5][0-9]\.[0-9]{3}"
TOKEN = "struct<kind:string,tag:string,classes:string,annotation:string,text:string,ts:struct<h:decimal(20,0),m:int,s:int,f:int>>"
NODE = (
    "struct<node_id:int,parent_id:int,depth:int,kind:string,tag:string,classes:string,annotation:string,text:string,"
    "ts:struct<h:decimal(20,0),m:int,s:int,f:int>,lang:string>"
)
STATE = "struct<n:int,ids:array<int>,tags:array<string>,langs:array<string>,over:array<string>>"
#: What the numbers 0x80 to 0x9F mean in windows-1252, where it has a character (fixed values).
C1 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D,
    0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
REPLACEMENT = "\ufffd"


def tokens(body: Column) -> Column:
    """``array<struct<kind, tag, classes, annotation, text, ts>>`` with kind
    Text, StartTag, EndTag or Timestamp; other tags are left out.  Texts,
    classes and annotations are raw."""

    def made(kind: str, tag: Column | None = None, classes: Column | None = None, annotation: Column | None = None, text: Column | None = None, ts: Column | None = None) -> Column:
        fields = {"kind": F.lit(kind), "tag": tag, "classes": classes, "annotation": annotation, "text": text, "ts": ts}
        return F.struct(*((F.lit(None) if value is None else value).alias(name) for name, value in fields.items())).cast(TOKEN)

    def opened(t: Column) -> Column:
        tag = F.regexp_extract(t, rf"^<({TAGS})", 1)

        def noted(inner: Column) -> Column:
            classes = F.regexp_replace(F.regexp_extract(inner, r"^[^\t\n\f ]*", 0), r"^\.", "")
            note = F.regexp_replace(F.regexp_extract(inner, r"(?s)^[^\t\n\f ]*[\t\n\f ](.*)\z", 1), r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")
            return made("StartTag", tag, classes, let(note, lambda n: F.when(n != "", n)))

        bare = made("StartTag", tag, F.lit(""))
        return let(F.regexp_replace(F.regexp_replace(t, rf"^<{TAGS}", ""), r">\z", ""), lambda inner: F.when(inner == "", bare).otherwise(noted(inner)))

    def token(t: Column) -> Column:
        stamp = F.when(t.rlike(rf"^(?:{STAMP}|{LOOSE_STAMP})\z"), times.vtt(F.regexp_replace(t, "[<>]", "")))
        stamped = let(stamp, lambda ts: F.when(ts.isNotNull(), made("Timestamp", ts=ts)))
        ended = made("EndTag", F.regexp_extract(t, rf"^</({TAGS})", 1))
        return F.when(~t.startswith("<"), made("Text", text=t)).when(t.rlike(rf"^{START}>?\z"), opened(t)).when(t.rlike(rf"^{END}\z"), ended).otherwise(stamped)

    found = F.regexp_extract_all(body, F.lit(r"([^<]+|<[^>]*>?)"), F.lit(1))
    return F.filter(F.transform(found, token), lambda t: t.isNotNull())


def _prefixes(names: list[str]) -> str:
    """A regex of the longest of ``names`` that a text begins with: branches
    share their beginnings, so that few are tried."""
    if names == [""]:
        return ""
    rest: dict[str, list[str]] = {}
    for name in names:
        if name:
            rest.setdefault(name[0], []).append(name[1:])
    branches = "|".join(letter + _prefixes(tails) for letter, tails in sorted(rest.items()))
    return f"(?:{branches})" + ("?" if "" in names else "")


@lru_cache(maxsize=1)
def _entities() -> tuple[str, str]:
    """The named references by their first letter, and by their second, as
    JSON, and a regex of those that need no semicolon."""
    by_letters: dict[str, dict[str, dict[str, str]]] = {}
    for name, text in html5.items():
        by_letters.setdefault(name[0], {}).setdefault(name[1], {})[name] = text
    return json.dumps(by_letters), _prefixes([n for n in html5 if not n.endswith(";")])


def _character(point: Column) -> Column:
    """The character of a code point; UTF-32 names any of them."""
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in C1.items() for x in (k, v)]), point.cast("int")), point.cast("int"))
    bad = point.isNull() | (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    return F.when(bad, REPLACEMENT).otherwise(F.decode(F.unhex(F.lpad(F.hex(mapped), 8, "0")), "UTF-32"))


def decode_references(text: Column) -> Column:
    """Character references decoded, and NUL as U+FFFD."""
    table, bare = _entities()
    named = F.from_json(F.lit(table), "map<string,map<string,map<string,string>>>")

    def known(name: Column) -> Column:
        # Maps are searched one by one, so the letters go first.
        return F.try_element_at(F.try_element_at(F.try_element_at(named, F.substring(name, 1, 1)), F.substring(name, 2, 1)), name)

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, r"^&#([0-9]+)", 1), "^0+(?=.)", "")
        hexes = F.regexp_replace(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+)", 1), "^0+(?=.)", "")
        number = F.when(hexes != "", F.when(F.length(hexes) <= 8, F.conv(hexes, 16, 10).try_cast("long"))).otherwise(F.when(F.length(digits) <= 10, digits.try_cast("long")))
        name = F.substring(p, 2, 1 << 30)
        # A piece that ends a name has its only semicolon at its end; names take 31 characters before it at most.
        whole = F.when(name.endswith(";") & (F.length(name) <= 32), known(name))
        short = let(F.regexp_extract(name, f"^{bare}", 0), lambda prefix: F.when(prefix != "", F.concat(known(prefix), F.substring(name, F.length(prefix) + 1, 1 << 30))))
        numbered = F.when(p.rlike(r"^&#[xX]?\z"), F.lower(p)).otherwise(_character(number))
        return F.when(~p.startswith("&") | (p == "&"), p).when(p.startswith("&#"), numbered).otherwise(F.coalesce(whole, short, p))

    pieces = F.regexp_extract_all(text, F.lit(r"(&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&#[xX]?|&[A-Za-z0-9]+;?|[^&]+|&)"), F.lit(1))
    decoded = F.array_join(F.transform(pieces, piece), "")
    return F.when(text.rlike(r"[&\x00]"), F.regexp_replace(F.when(F.instr(text, "&") > 0, decoded).otherwise(text), r"\x00", REPLACEMENT)).otherwise(text)


def normalize_annotation(raw: Column) -> Column:
    """Decoded, then trimmed of ASCII white space and its runs made one space."""
    return F.trim(F.regexp_replace(decode_references(raw), r"[\t\n\f\r ]+", " "))


def class_list(classes: Column) -> Column:
    return F.filter(F.split(classes, r"\."), lambda c: c != "")


def plain_text(body: Column) -> Column:
    """The decoded texts of a cue, without its tags."""
    texts = F.filter(tokens(body), lambda t: t["kind"] == "Text")
    return F.array_join(F.transform(texts, lambda t: decode_references(t["text"])), "")


def raw_text(body: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens(body), lambda t: t["kind"] == "Text"), lambda t: t["text"]), "")


def tree(body: Column, max_depth: int = 16) -> Column:
    """``struct<nodes, exceeded>``: the nodes of a cue's tree in document
    order, and whether a tag lay deeper than ``max_depth``.

    Deeper tags are dropped, their contents kept, and their end tags matched.
    ``rt`` attaches only to ``ruby``.  ``lang`` is the normalized annotation of
    the nearest enclosing ``lang`` tag, the node itself included; null without
    one, and empty where it names none.
    """
    texts = lambda: F.array().cast("array<string>")
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"), texts().alias("tags"), texts().alias("langs"), texts().alias("over"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    less = lambda a, n: F.slice(a, F.lit(1), F.size(a) - n)

    def opening(s: Column, t: Column) -> Column:
        return (t["kind"] == "StartTag") & ((t["tag"] != "rt") | (F.coalesce(last(s["over"]), last(s["tags"]), F.lit("")) == "ruby"))

    def fits(s: Column) -> Column:
        return (F.size(s["over"]) == 0) & (F.size(s["ids"]) < max_depth)

    def language(s: Column, t: Column) -> Column:
        own = (t["kind"] == "StartTag") & (t["tag"] == "lang")
        return F.when(own, F.coalesce(normalize_annotation(t["annotation"]), F.lit(""))).otherwise(last(s["langs"]))

    def start(s: Column, t: Column) -> Column:
        entered = F.struct(s["n"] + 1, F.concat(s["ids"], F.array(s["n"])), F.concat(s["tags"], F.array(t["tag"])), F.concat(s["langs"], F.array(language(s, t))), s["over"]).cast(STATE)
        passed = F.struct(s["n"], s["ids"], s["tags"], s["langs"], F.concat(s["over"], F.array(t["tag"]))).cast(STATE)
        return F.when(~opening(s, t), s).when(fits(s), entered).otherwise(passed)

    def end(s: Column, t: Column) -> Column:
        def left(closing: Column) -> Column:
            shed = F.least(closing, F.size(s["over"]))
            cut = closing - shed
            return F.struct(s["n"], less(s["ids"], cut), less(s["tags"], cut), less(s["langs"], cut), less(s["over"], shed)).cast(STATE)

        now = F.coalesce(last(s["over"]), last(s["tags"]), F.lit(""))
        closing = F.when(now == t["tag"], 1).when((now == "rt") & (t["tag"] == "ruby"), 2).otherwise(0)
        return F.when(closing > 0, left(closing)).otherwise(s)

    def step(s: Column, t: Column) -> Column:
        leaf = F.struct(s["n"] + 1, s["ids"], s["tags"], s["langs"], s["over"]).cast(STATE)
        return F.when(t["kind"] == "StartTag", start(s, t)).when(t["kind"] == "EndTag", end(s, t)).otherwise(leaf)

    def node(t: Column, s: Column) -> Column:
        opens = t["kind"] == "StartTag"
        made = F.struct(
            s["n"].alias("node_id"), last(s["ids"]).alias("parent_id"), F.size(s["ids"]).alias("depth"), F.when(opens, "Tag").otherwise(t["kind"]).alias("kind"), t["tag"].alias("tag"),
            t["classes"].alias("classes"), t["annotation"].alias("annotation"), t["text"].alias("text"), t["ts"].alias("ts"), language(s, t).alias("lang"),
        ).cast(NODE)
        adds = F.when(opens, opening(s, t) & fits(s)).otherwise(t["kind"] != "EndTag")
        return F.struct(F.when(adds, made).alias("node"), (opens & opening(s, t) & ~fits(s)).alias("exceeded"))

    made = running(tokens(body), empty, step, STATE, lambda s, t: node(t, s), f"struct<node:{NODE},exceeded:boolean>")
    return let(made, lambda ms: F.struct(F.transform(F.filter(ms, lambda m: m["node"].isNotNull()), lambda m: m["node"]).alias("nodes"), F.exists(ms, lambda m: m["exceeded"]).alias("exceeded")))


def try_tree(body: Column, max_depth: int = 16) -> Column:
    """``struct<nodes, error>``: null nodes and ``MaxDepthExceeded`` beyond the depth."""
    t = tree(body, max_depth)
    return F.struct(F.when(~t["exceeded"], t["nodes"]).alias("nodes"), F.when(t["exceeded"], f"MaxDepthExceeded({max_depth})").alias("error"))


def edit(nodes: Column, where: Callable[[Column], Column], **fields: Callable[[Column], Column]) -> Column:
    """Nodes with new ``tag``, ``classes`` or ``annotation`` where a condition
    on the node holds; each a function of the node."""

    def changed(n: Column) -> Column:
        new = n
        for name, value in fields.items():
            new = new.withField(name, value(n))
        return F.when(where(n), new.cast(NODE)).otherwise(n)

    return F.transform(nodes, changed)


def children_of(nodes: Column, at: Column | None = None) -> Column:
    """The nodes right below node number ``at``, or at the top."""
    return F.filter(nodes, lambda n: n["parent_id"].eqNullSafe(F.lit(None).cast("int") if at is None else at))


def unwrapped(nodes: Column, at: Column) -> Column:
    """Nodes without node number ``at``, its children in its place."""

    def whole(ns: Column, gone: Column) -> Column:
        def moved(end: Column) -> Callable[[Column], Column]:
            def one(n: Column) -> Column:
                below = (n["node_id"] > at) & (n["node_id"] < end)
                parent = F.when(n["parent_id"] == at, gone["parent_id"]).otherwise(F.when(n["parent_id"] > at, n["parent_id"] - 1).otherwise(n["parent_id"]))
                return n.withField("parent_id", parent).withField("depth", n["depth"] - below.cast("int")).withField("node_id", n["node_id"] - (n["node_id"] > at).cast("int")).cast(NODE)

            return one

        end = F.coalesce(F.array_min(F.transform(F.filter(ns, lambda n: (n["node_id"] > at) & (n["depth"] <= gone["depth"])), lambda n: n["node_id"])), F.size(ns))
        return let(end, lambda e: F.transform(F.filter(ns, lambda n: n["node_id"] != at), moved(e)))

    return let(nodes, lambda ns: F.when(F.size(ns) > at, let(F.get(ns, at), lambda gone: whole(ns, gone))).otherwise(ns))


def _open_tag(n: Column) -> Column:
    classes = F.when(n["classes"] != "", F.concat(F.lit("."), n["classes"])).otherwise("")
    note = F.when(n["annotation"].isNotNull(), F.concat(F.lit(" "), n["annotation"])).otherwise("")
    return F.concat(F.lit("<"), n["tag"], classes, note, F.lit(">"))


def serialize(nodes: Column) -> Column:
    """Cue text of a node array: texts decoded, annotations raw.  A tag is
    closed before the first later node that is not deeper, innermost first."""

    def close(open_: Column, to: Column) -> Column:
        shut = F.reverse(F.slice(open_, to + 1, F.greatest(F.size(open_) - to, F.lit(0))))
        return F.array_join(F.transform(shut, lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")

    def step(open_: Column, n: Column) -> Column:
        left = F.slice(open_, F.lit(1), n["depth"])
        return F.when(n["kind"] == "Tag", F.concat(left, F.array(n["tag"]))).otherwise(left)

    def piece(n: Column, open_: Column) -> Column:
        shown = F.when(n["kind"] == "Tag", _open_tag(n)).when(n["kind"] == "Timestamp", F.concat(F.lit("<"), times.encode_vtt(n["ts"]), F.lit(">"))).otherwise(decode_references(n["text"]))
        return F.concat(close(open_, n["depth"]), shown)

    def whole(ns: Column) -> Column:
        # A last node at the top, without text, closes what is open.
        end = F.struct(F.size(ns), F.lit(None), F.lit(0), F.lit("Text"), F.lit(None), F.lit(None), F.lit(None), F.lit(""), F.lit(None), F.lit(None)).cast(NODE)
        return F.array_join(running(F.concat(ns, F.array(end)), F.array().cast("array<string>"), step, "array<string>", lambda open_, n: piece(n, open_), "string"), "")

    return let(nodes, whole)


def dump(nodes: Column) -> Column:
    """One line per node and attribute, indented by depth."""

    def lines(n: Column) -> Column:
        margin = lambda extra=0: F.concat(F.lit("| "), F.repeat(F.lit("  "), n["depth"] + extra))
        hours = F.when(n["ts"]["h"] == 0, F.concat(F.lit("00:"), times.encode_vtt(n["ts"]))).otherwise(times.encode_vtt(n["ts"]))
        tag = F.when(n["tag"].isin("c", "v", "lang"), "span").otherwise(n["tag"])
        head = F.when(n["kind"] == "Tag", F.concat(F.lit("<"), tag, F.lit(">"))).when(n["kind"] == "Timestamp", F.concat(F.lit("<?timestamp "), hours, F.lit(">")))
        head = head.otherwise(F.concat(F.lit('"'), decode_references(n["text"]), F.lit('"')))
        note = F.coalesce(normalize_annotation(n["annotation"]), F.lit(""))
        classes = F.array_join(class_list(n["classes"]), " ")
        return F.concat_ws(
            "\n",
            F.concat(margin(), head),
            F.when(classes != "", F.concat(margin(1), F.lit('class="'), classes, F.lit('"'))),
            F.when(n["tag"] == "v", F.concat(margin(1), F.lit('title="'), note, F.lit('"'))),
            F.when(n["tag"] == "lang", F.concat(margin(1), F.lit('lang="'), note, F.lit('"'))),
        )

    return F.array_join(F.transform(nodes, lines), "\n")
