"""Main text of web pages by wrapper induction.

Pages of a host share a template.  One page of each host serves as reference;
every page's DOM, with runs of like siblings folded into one repeated slot, is
aligned with the reference tree by simple tree matching.  Nodes that the
reference lacks are aligned with each other by their path of keys, so that
other layouts, and a host whose reference is a stub, are aligned as well.
Aggregation per host and slot then tells texts that stay constant in a slot,
or that a slot shows by turns on pages of different content, which are
template, from the others, which are content.  Roles that a page names itself
(menus, footers, adverts and so on) are never content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut, written
from cueframe.llm.language import host_of

#: Fixed values of HTML: elements without an end tag, raw-text elements, elements that make blocks,
#: and the open elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_CLOSERS = BLOCKS - {"body", "caption", "dd", "dt", "html", "legend", "li", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements and names whose contents are never main text.
DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video form button select textarea input dialog title".split())
PARTS = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent notice popup modal "
    "newsletter subscribe share sharing social related comment comments disqus replies reply form".split()
)


class Hints(NamedTuple):
    """What a page may say of its own parts: class, id and role names and
    elements that are never content, and elements that alone hold it."""

    names: frozenset[str] = NAMES
    roles: frozenset[str] = ROLES
    parts: frozenset[str] = PARTS
    mains: frozenset[str] = frozenset({"article", "main"})


NO_HINTS = Hints(frozenset(), frozenset(), frozenset(), frozenset())

#: Unlike neighbours among the blocks below one element, beyond which all of one key are folded.
WIDE = 64

#: Reference pages of all hosts together, in bytes, that are broadcast at most.
REFERENCE_BYTES = 16 << 20


#: What ends comments and declarations, and comments that end as they begin.
_COMMENT_END, _TAG_END, _SECTION_END, _SUBSET_END = (re.compile(x) for x in ("--!?>", ">", r"\]\]>", r"\]\s*>"))
_NO_COMMENT, _SUBSET, _OPEN_TAG = re.compile("<!---?>"), re.compile(r"(?i)<!doctype[^>\[]*\["), re.compile("</?[a-zA-Z]")


class Node:
    __slots__ = ("children", "folds", "key", "own", "role", "tag")

    def __init__(self, tag: str, role: bool):
        self.tag, self.role = tag, role
        self.children: list[Node | str] = []
        self.key = tag
        self.own: list[str] = []
        self.folds: list[int] | None = None


class _Builder(HTMLParser):
    """A lenient DOM: implied end tags, stray end tags left out, and unclosed
    comments, declarations and tags that swallow the rest of the page."""

    def __init__(self, hints: Hints):
        super().__init__(convert_charrefs=True)
        self.hints = hints
        self.root = Node("#root", False)
        self.open = [self.root]
        #: How often each tag is open: what is not open need not be looked for.
        self.counts: Counter[str] = Counter()

    def _past(self, pattern: re.Pattern, at: int) -> int:
        found = pattern.search(self.rawdata, at)
        return found.end() if found else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        at = _NO_COMMENT.match(self.rawdata, i)
        return at.end() if at else self._past(_COMMENT_END, i + 4)

    def parse_pi(self, i: int) -> int:
        return self._past(_TAG_END, i)

    def parse_html_declaration(self, i: int) -> int:
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if raw.startswith("<![CDATA[", i):
            return self._past(_SECTION_END, i)
        subset = _SUBSET.match(raw, i)
        return self._past(_SUBSET_END, subset.end()) if subset else self._past(_TAG_END, i)

    def _close(self, at: int) -> None:
        self.counts.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def _close_last(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self.counts[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return self._close(i)
            if self.open[i].tag in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in P_CLOSERS:
            self._close_last({"p"}, {"td", "th", "table", "button", "caption"})
        if tag in CLOSES:
            self._close_last(*CLOSES[tag])
        named = [v for k, v in attrs if k in ("class", "id", "role") and v]
        hints = self.hints
        role = tag in DROPPED or tag in hints.parts or (tag == "header" and bool(hints.mains) and not any(self.counts[t] for t in hints.mains))
        if named:
            names = {part for v in named for word in v.lower().split() for part in (word, *word.replace("_", "-").split("-"))}
            role = role or bool(names & hints.names) or any(k == "role" and v and v.lower() in hints.roles for k, v in attrs)
        node = Node(tag, role)
        if named:
            node.key = tag + "." + ".".join(sorted(named))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "math"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if tag not in BLOCKS and self.open[i].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None, hints: Hints = Hints()) -> Node:  # noqa: B008
    builder = _Builder(hints)
    builder.feed(html or "")
    # What is left is text, or a tag that the page breaks off in.
    if _OPEN_TAG.match(builder.rawdata):
        builder.rawdata = ""
    builder.close()
    return builder.root


def _unrolled(walk: Generator) -> object:
    """What a generator returns that yields another one for each call of its
    own: recursion as deep as a page, on a list."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def folds(node: Node) -> list[int]:
    """For each block below a node the number of the folded sibling that it
    belongs to: runs of one key are one.  Where more than ``WIDE`` are left, as
    in striped tables and lists of terms, all of one key are."""
    if node.folds is None:
        keys = [c.key for c in node.children if isinstance(c, Node) and c.tag in BLOCKS]
        runs = [int(k > 0 and key != keys[k - 1]) for k, key in enumerate(keys)]
        found = list(accumulate(runs))
        if found and found[-1] >= WIDE:
            number: dict[str, int] = {}
            found = [number.setdefault(key, len(number)) for key in keys]
        node.folds = found
    return node.folds


def folded(root: Node) -> tuple:
    """The tree of element keys as nested tuples, inline elements and texts left
    out and siblings folded (``folds``) into the first."""

    def walk(node: Node) -> Generator:
        children: list[tuple] = []
        if node.tag not in DROPPED:
            for child, at in zip((c for c in node.children if isinstance(c, Node) and c.tag in BLOCKS), folds(node), strict=True):
                if at == len(children):
                    children.append((yield walk(child)))
        return (node.key, tuple(children))

    return _unrolled(walk(root))


def _numbered(tree: tuple) -> tuple[list[str], list[list[int]]]:
    """Keys of the nodes in document order, and the numbers of their children."""
    keys: list[str] = []
    kids: list[list[int]] = []
    stack = [(tree, -1)]
    while stack:
        (key, children), up = stack.pop()
        if up >= 0:
            kids[up].append(len(keys))
        stack += [(c, len(keys)) for c in reversed(children)]
        keys.append(key)
        kids.append([])
    return keys, kids


class _Shapes:
    """Subtrees known by number: equal ones have one, whatever tree they are of."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.key: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def of(self, keys: list[str], kids: list[list[int]]) -> list[int]:
        shape = [0] * len(keys)
        for i in range(len(keys) - 1, -1, -1):
            below = tuple(shape[k] for k in kids[i])
            known = self.number.setdefault((keys[i], below), len(self.key))
            if known == len(self.key):
                self.key.append(keys[i])
                self.below.append(below)
                self.size.append(1 + sum(self.size[c] for c in below))
            shape[i] = known
        return shape


def _heaviest(pairs: list[tuple[int, int, int]], n: int) -> tuple[int, list[tuple[int, int]]]:
    """Of ``(i, j, weight)``, by rising ``i`` and falling ``j`` below ``n``, the
    heaviest that rise in both: a prefix maximum by a binary indexed tree, and a link back for each."""
    best: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    back = []
    for at, (_, j, weight) in enumerate(pairs):
        most, k = (0, -1), j
        while k > 0:
            most = max(most, best[k])
            k -= k & -k
        back.append(most[1])
        now, k = (most[0] + weight, at), j + 1
        while k <= n:
            if best[k][0] < now[0]:
                best[k] = now
            k += k & -k
    total, at, k = 0, -1, n
    while k > 0:
        if best[k][0] > total:
            total, at = best[k]
        k -= k & -k
    met = []
    while at >= 0:
        met.append(pairs[at][:2])
        at = back[at]
    return total, met[::-1]


def tree_match(a: tuple, b: tuple) -> tuple[int, list[int]]:
    """Simple tree matching: the most nodes that two ordered trees share with
    equal roots, and for each node of ``a`` in document order its partner's
    number in ``b`` (or -1).

    Pairs of equal subtrees are matched once, however often they come; equal
    siblings at either end meet each other; between these only siblings of one
    key are looked at, so no table of all pairs is made."""
    (x, below), (y, beneath) = _numbered(a), _numbered(b)
    partner = [-1] * len(x)
    if x[0] != y[0]:
        return 0, partner
    shapes = _Shapes()
    left, right = shapes.of(x, below), shapes.of(y, beneath)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(p: int, q: int) -> Generator:
        """Score, and which children meet, of two unequal subtrees."""
        c, d = shapes.below[p], shapes.below[q]
        least = min(len(c), len(d))
        start = next((k for k in range(least) if c[k] != d[k]), least)
        end = next((k for k in range(least - start) if c[-1 - k] != d[-1 - k]), least - start)
        met = [(k, k) for k in range(start)]
        places: dict[str, list[int]] = {}
        for j in range(len(d) - end - 1, start - 1, -1):
            places.setdefault(shapes.key[d[j]], []).append(j)
        pairs = []
        for i in range(start, len(c) - end):
            for j in places.get(shapes.key[c[i]], ()):
                if c[i] == d[j]:
                    weight = shapes.size[c[i]]
                else:
                    if (c[i], d[j]) not in known:
                        known[c[i], d[j]] = yield match(c[i], d[j])
                    weight = known[c[i], d[j]][0]
                pairs.append((i, j - start, weight))
        total, inner = _heaviest(pairs, len(d) - end - start)
        met += [(i, j + start) for i, j in inner]
        met += [(len(c) - k, len(d) - k) for k in range(end, 0, -1)]
        return 1 + total + sum(shapes.size[c[k]] for k in (*range(start), *range(len(c) - end, len(c)))), met

    if left[0] != right[0]:
        known[left[0], right[0]] = _unrolled(match(left[0], right[0]))
    score = shapes.size[left[0]] if left[0] == right[0] else known[left[0], right[0]][0]
    met = [(0, 0)]
    for p, q in met:
        partner[p] = q
        if left[p] == right[q]:
            met += zip(below[p], beneath[q], strict=True)
        else:
            met += [(below[p][i], beneath[q][j]) for i, j in known[left[p], right[q]][1]]
    return score, partner


def _count(t: tuple) -> int:
    return len(_numbered(t)[0])


@lru_cache(maxsize=256)
def _reference(html: str, hints: Hints) -> tuple:
    return folded(parse(html, hints))


def blocks(root: Node, slots: list[int], mains: frozenset[str] = Hints().mains) -> list[tuple[int, str]]:
    """(slot, text) of the blocks outside dropped roles, in page order.  The
    slot is that of the innermost folded element; ``slots`` numbers them."""
    out: list[tuple[int, str]] = []
    count = [0]
    has_main = _find(root, mains)

    def flush(slot: int, parts: list[str]) -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((slot, text))
        parts.clear()

    def skip(node: Node) -> Generator:
        """Numbers what a walk over the folded tree would have numbered."""
        if node.tag not in DROPPED:
            seen = 0
            for child, at in zip((c for c in node.children if isinstance(c, Node) and c.tag in BLOCKS), folds(node), strict=True):
                if at == seen:
                    seen += 1
                    count[0] += 1
                    yield skip(child)

    def walk(node: Node, slot: int, parts: list[str], inside: bool, fresh: bool) -> Generator:
        # The slots of the folded siblings so far.
        seen: list[int] = []
        numbers = iter(folds(node))
        for child in node.children:
            if isinstance(child, str):
                if inside:
                    parts.append(child)
            elif child.tag in BLOCKS:
                at = next(numbers)
                new = at == len(seen)
                if new:
                    count[0] += fresh
                    seen.append(count[0] if fresh else slot)
                last_slot = seen[at]
                if inside:
                    flush(slot, parts)
                if child.role:
                    if new and fresh:
                        yield skip(child)
                    continue
                inner: list[str] = []
                now = inside or child.tag in mains
                yield walk(child, last_slot, inner, now, new and fresh)
                if now:
                    flush(last_slot, inner)
            elif child.tag == "br":
                parts.append(" ")
            elif not child.role:
                yield walk_inline(child, slot, parts, inside)

    def walk_inline(node: Node, slot: int, parts: list[str], inside: bool) -> Generator:
        for child in node.children:
            if isinstance(child, str):
                if inside:
                    parts.append(child)
            elif child.role:
                continue
            elif child.tag in BLOCKS:
                flush(slot, parts)
                inner: list[str] = []
                yield walk(child, slot, inner, inside or child.tag in mains, False)
                flush(slot, inner)
            elif child.tag == "br":
                parts.append(" ")
            else:
                yield walk_inline(child, slot, parts, inside)

    parts: list[str] = []
    _unrolled(walk(root, 0, parts, not has_main, True))
    flush(0, parts)
    return [(slots[s] if s < len(slots) else -1, t) for s, t in out]


def _find(node: Node, tags: frozenset[str]) -> bool:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in tags and not n.role:
            return True
        stack += [c for c in n.children if isinstance(c, Node)]
    return False


def _paths(tree: tuple) -> list[int]:
    """For each node in document order a slot below -1: the hash of its path of
    keys and of how many nodes before it have the same path."""
    out: list[int] = []
    seen: dict[int, int] = {}
    stack = [(tree, 0)]
    while stack:
        (key, children), up = stack.pop()
        path = _code(up, key)
        seen[path] = seen.get(path, 0) + 1
        out.append(-2 - (_code(path, seen[path]) & (1 << 62) - 1))
        stack += [(c, path) for c in reversed(children)]
    return out


def align(html: str | None, reference: str | None, hints: Hints = Hints()) -> list[tuple[int, str]]:  # noqa: B008
    """(slot, text) of a page's blocks: the slot is the reference's node, or
    stands for the path where the reference has none."""
    root = parse(html, hints)
    tree = folded(root)
    partner = tree_match(tree, _reference(reference, hints))[1] if reference else [-1] * _count(tree)
    if reference and -1 in partner:
        partner = [p if p >= 0 else own for p, own in zip(partner, _paths(tree), strict=True)]
    return blocks(root, partner, hints.mains)


def _code(*parts: object) -> int:
    """A 64-bit hash of the parts, the same in every process."""
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _coded(found: list[tuple[int, str]]) -> list[dict]:
    """Blocks with a hash of their slot and all that it holds on the page."""
    held: dict[int, list[str]] = {}
    for slot, text in found:
        held.setdefault(slot, []).append(text)
    codes = {slot: _code(slot, *texts) for slot, texts in held.items()}
    return [{"slot": s, "x": codes[s], "text": t} for s, t in found]


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = 3,
    constant: float = 0.95,
    least_turns: int = 20,
    single: float = 0.05,
    rare: float = 0.002,
    hints: Hints = Hints(),  # noqa: B008
) -> DataFrame:
    """``(id, url, text, n_chars)`` for every row.

    A text in a slot is template if at least ``least_pages`` pages of the host
    with different texts have the slot and ``constant`` of them hold that text
    in it; or if ``least_turns`` pages whose longest other blocks differ have
    the slot, at most ``single`` of them hold a text there that no other does,
    and two or more, ``rare`` of them, hold this one.  Another text in the same
    slot stays.  A page that would lose all its blocks keeps them: what is
    constant there is its content.  ``hints`` are what pages say of
    themselves.  Null and empty
    pages, and pages without main text, give an empty text; a page whose host
    is unknown or new keeps every block that no role rules out; a comment,
    declaration or tag that never ends takes the rest of its page; repeated rows
    come back repeated; an empty table gives no rows; other columns are not
    read.  Memory follows the
    longest page: siblings are folded, equal subtrees are matched once, and no
    table of pairs is made.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.withColumn("_host", F.coalesce(host_of(F.col("_url")), F.lit(""))).withColumn("_h", F.xxhash64("_html", F.lit(10)))
    # One reference page a host, the page whose hash is lowest; found before any page moves.
    chosen = rows.where("_html is not null and _host <> ''").groupBy("_host").agg(F.min_by("_html", "_h").alias("_ref"))
    chosen = cut(chosen)
    size = chosen.agg(F.sum(F.octet_length("_ref") + F.octet_length("_host"))).first()[0] or 0
    # A checked size is broadcast, so that pages stay where they are read; beyond it both sides are shuffled by host.
    chosen = F.broadcast(chosen) if size <= REFERENCE_BYTES else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.schema.names
            html, ref = b.column(fields.index("_html")), b.column(fields.index("_ref"))
            found = [align(h.as_py(), r.as_py(), hints) for h, r in zip(html, ref, strict=True)]
            keep = [n for n in fields if n not in ("_html", "_ref")]
            lists = pa.array([_coded(f) for f in found], pa.list_(pa.struct([("slot", pa.int64()), ("x", pa.int64()), ("text", pa.string())])))
            whole = pa.array([_code(*(t for _, t in f)) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), whole, lists], [*keep, "_page", "_blocks"])

    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _url string, _host string, _page long, _blocks array<struct<slot:long,x:long,text:string>>"
    aligned = rows.join(chosen, "_host", "left").select("_id", "_url", "_host", "_html", "_ref")
    aligned = written(aligned.mapInArrow(run, schema), "pages")
    def texts_of(rows: DataFrame, page: str, blocks: str) -> DataFrame:
        """What each slot of a page holds, all its blocks together, and how many different pages agree."""
        held = rows.where("_host <> ''").select("_host", page, F.explode(blocks).alias("b")).select("_host", page, "b.slot", "b.x").where("slot <> -1").distinct()
        return held.groupBy("_host", "slot", "x").count()

    def without(rows: DataFrame, texts: DataFrame, blocks: str) -> DataFrame:
        """``rows`` with ``_left``: their blocks but for the host's ``texts``.  As with the
        references, a checked size is broadcast; beyond it both sides are shuffled by host."""
        sets = cut(texts.groupBy("_host").agg(F.collect_set("x").alias("_gone")))
        n = sets.agg(F.sum(2 * F.size("_gone") + 8)).first()[0] or 0
        joined = rows.join(F.broadcast(sets) if 4 * n <= REFERENCE_BYTES else sets, "_host", "left")
        left = F.when(F.col("_gone").isNull(), F.col(blocks)).otherwise(F.filter(blocks, lambda b: ~F.array_contains(F.col("_gone"), b.x)))
        return joined.withColumn("_left", left).drop("_gone")

    def measured(texts: DataFrame) -> DataFrame:
        """``texts`` with ``n`` and ``lone`` of their slots: few rows, broadcast below a checked size."""
        slots = cut(texts.groupBy("_host", "slot").agg(F.sum("count").alias("n"), F.count_if(F.col("count") == 1).alias("lone")))
        few = slots.count() * 64 <= REFERENCE_BYTES
        return texts.join(F.broadcast(slots) if few else slots, ["_host", "slot"])

    # A slot's constant text holds nearly all of its pages, so it is one.
    same = measured(texts_of(aligned, "_page", "_blocks"))
    known = without(aligned, same.where((F.col("n") >= least_pages) & (F.col("count") >= constant * F.col("n"))), "_blocks").withColumnRenamed("_left", "_vary")
    # Of what varies, texts that come by turns: pages differ if their longest block does, so that near copies count once.
    longest = F.array_max(F.transform("_vary", lambda b: F.struct(F.length(b.text).alias("n"), F.xxhash64(b.text).alias("h"))))["h"]
    turns = measured(texts_of(known.withColumn("_lead", longest), "_lead", "_vary"))
    often = (F.col("n") >= least_turns) & (F.col("lone") <= single * F.col("n")) & (F.col("count") >= F.greatest(F.lit(2), rare * F.col("n")))
    known = without(known, turns.where(often), "_vary")
    varying = F.when(F.size("_left") > 0, F.col("_left")).when(F.size("_vary") > 0, F.col("_vary")).otherwise(F.col("_blocks"))
    text = F.array_join(F.transform(varying, lambda b: b.text), "\n\n")
    return known.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


__all__ = ["NO_HINTS", "Hints", "align", "blocks", "folded", "main_text", "parse", "tree_match"]
