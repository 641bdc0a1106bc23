"""WebVTT documents as rows, and back.

Every block ends at an empty line, so a document falls into paragraphs, and
the lines of a paragraph are placed by array functions: which line opens a
note, a style, a region or a cue, and which lines then belong to it.  Only "has
a cue been seen", which bars styles and regions, crosses paragraphs; as it
cannot change before the first cue, the first cue's place settles it.  A
document is read within its row: nothing is shuffled, and rows of one id are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions import times
from cueframe.functions.arrays import exploded, first_place, let
from cueframe.functions.lines import BOM, body_of, raw_lines, trim_start_white, trim_white, unterminated, with_all, without_bom
from cueframe.functions.vtt_text import serialize

ARROW = "-->"
TIMING = rf"^{BOM}*[ \t\f]*{times.VTT}[ \t\f]+-->[ \t\f]+{times.VTT}"
#: A run of lines none of which is empty; possessive, so that no long run is tried twice.
PARAGRAPH = r"((?:[^\r\n]++(?:\r\n|\r|\n|\z))++)"
SIGNATURE = r"^WEBVTT(?:\z|[ \t])"
#: Closed value sets (fixed values).
VERTICAL, ALIGN = ("rl", "lr"), ("start", "center", "end", "left", "right")
LINE_ALIGN, POSITION_ALIGN = ("start", "center", "end"), ("line-left", "center", "line-right", "auto")
_FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
BLOCK = (
    "struct<block_type:string,identifier:string,start:struct<h:decimal(20,0),m:int,s:int,f:int>,end:struct<h:decimal(20,0),m:int,s:int,f:int>,start_ms:decimal(30,0),end_ms:decimal(30,0),"
    "settings:struct<vertical:string,line:struct<pct:double,num:int,align:string>,position:struct<pct:double,align:string>,size:double,align:string,region:string>,body:string,"
    "region:struct<id:string,width:double,lines:bigint,region_anchor:struct<x:double,y:double>,viewport_anchor:struct<x:double,y:double>,scroll:string>,error:string>"
)


def percentage(text: Column) -> Column:
    """``N%`` with N in [0, 100], or null."""
    value = F.when(text.rlike(rf"^{_FLOAT}%\z"), F.regexp_replace(text, r"^\+|%\z", "")).try_cast("double")
    return F.when((value >= 0) & (value <= 100), value)


def _integer(text: Column, kind: str) -> Column:
    sign = "[+-]?" if kind == "int" else r"\+?"
    value = F.when(text.rlike(rf"^{sign}0*[0-9]{{1,18}}\z"), F.regexp_replace(text, r"^\+", "").try_cast("long"))
    low, high = (-(2**31), 2**31 - 1) if kind == "int" else (0, 2**32 - 1)
    return F.when(value.between(low, high), value)


def _last(tokens: Column, key: str, value_of) -> Column:
    """The last valid value of a key among ``key:value`` tokens."""
    own = F.transform(F.filter(tokens, lambda t: t.startswith(f"{key}:")), lambda t: value_of(F.substring(t, len(key) + 2, 1 << 30)))
    return F.get(F.reverse(F.filter(own, lambda v: v.isNotNull())), F.lit(0))


def _settings(tokens: Column) -> Column:
    head, tail = lambda v: F.substring_index(v, ",", 1), lambda v: F.when(F.instr(v, ",") > 0, F.substring(v, F.instr(v, ",") + 1, F.length(v)))

    def line(v: Column) -> Column:
        pct = percentage(head(v))
        num = F.when(pct.isNull(), _integer(head(v), "int").cast("int"))
        fine = (pct.isNotNull() | num.isNotNull()) & (tail(v).isNull() | tail(v).isin(*LINE_ALIGN))
        return F.when(fine, F.struct(pct.alias("pct"), num.alias("num"), tail(v).alias("align")))

    def position(v: Column) -> Column:
        pct = percentage(head(v))
        return F.when(pct.isNotNull() & (tail(v).isNull() | tail(v).isin(*POSITION_ALIGN)), F.struct(pct.alias("pct"), tail(v).alias("align")))

    return F.struct(
        _last(tokens, "vertical", lambda v: F.when(v.isin(*VERTICAL), v)).alias("vertical"),
        _last(tokens, "line", line).alias("line"),
        _last(tokens, "position", position).alias("position"),
        _last(tokens, "size", percentage).alias("size"),
        _last(tokens, "align", lambda v: F.when(v.isin(*ALIGN), v)).alias("align"),
        _last(tokens, "region", lambda v: v).alias("region"),
    )


def cue_settings(text: Column) -> Column:
    """The settings after a timing as a struct; null where none is valid."""

    def some(found: Column) -> Column:
        any_ = F.lit(False)
        for name in ("vertical", "line", "position", "size", "align", "region"):
            any_ = any_ | found[name].isNotNull()
        return F.when(any_, found)

    def upto(tokens: Column) -> Column:
        stop = first_place(tokens, lambda t: F.instr(t, ":") == F.length(t))
        return let(F.when(stop > 0, F.slice(tokens, F.lit(1), stop - 1)).otherwise(tokens), lambda ts: let(_settings(ts), some))

    return F.when(F.instr(text, ":") > 0, let(F.filter(F.split(text, r"[ \t\f]"), lambda t: F.instr(t, ":") > 0), upto))


def anchor(text: Column) -> Column:
    x, y = percentage(F.substring_index(text, ",", 1)), percentage(F.substring(text, F.instr(text, ",") + 1, F.length(text)))
    return F.when((F.instr(text, ",") > 0) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def region_settings(body: Column) -> Column:
    """A region block's settings, one ``key:value`` a line, over the defaults."""
    tokens = F.transform(F.split(body, r"\r?\n"), trim_white)
    tokens = F.filter(tokens, lambda t: (F.instr(t, ":") > 0) & (F.instr(t, ":") < F.length(t)))
    return let(tokens, _region)


def _region(tokens: Column) -> Column:
    hundred = F.lit(100.0)
    return F.struct(
        F.coalesce(_last(tokens, "id", lambda v: F.when(F.instr(v, ARROW) == 0, v)), F.lit("")).alias("id"),
        F.coalesce(_last(tokens, "width", percentage), hundred).alias("width"),
        F.coalesce(_last(tokens, "lines", lambda v: _integer(v, "unsigned")), F.lit(3)).cast("long").alias("lines"),
        F.coalesce(_last(tokens, "regionanchor", anchor), F.struct(F.lit(0.0).alias("x"), hundred.alias("y"))).alias("region_anchor"),
        F.coalesce(_last(tokens, "viewportanchor", anchor), F.struct(F.lit(0.0).alias("x"), hundred.alias("y"))).alias("viewport_anchor"),
        _last(tokens, "scroll", lambda v: F.when(v == "up", v)).alias("scroll"),
    )


def _opener(text: Column, word: str) -> Column:
    return text.rlike(rf"^{word}(?:\z|[ \t])")


def _stamps(line: Column) -> tuple[Column, Column]:
    return times.vtt(F.regexp_extract(line, TIMING, 1)), times.vtt(F.regexp_extract(line, TIMING, 2))


def _placed(raws: Column, header: Column) -> Column:
    """The lines of a paragraph with what they may be, and the place of the
    first timing that makes a cue whatever else the document holds."""

    def line(raw: Column) -> Column:
        def told(x: Column) -> Column:
            arrow = F.instr(x, ARROW) > 0
            start, end = _stamps(x)
            timed = arrow & x.rlike(TIMING) & start.isNotNull() & end.isNotNull()
            return F.struct(raw.alias("raw"), x.alias("line"), without_bom(x).alias("text"), arrow.alias("arrow"), timed.alias("timed"))

        return let(unterminated(raw, lone_cr=True), told)

    def marked(ls: Column) -> Column:
        arrow = first_place(ls, lambda x: x["arrow"])

        def mark(x: Column, i: Column) -> Column:
            # A line is looked at as the start of a block unless the line before it made it a cue's timing, or it is a cue's text or header text.
            later = (arrow > 0) & (arrow <= i)
            fresh = F.when(x["arrow"], later | header | (i == 0) | (F.get(ls, i - 1)["text"] == "")).otherwise(~later & ~header)
            note, style, region = (fresh & _opener(x["text"], w) for w in ("NOTE", "STYLE", "REGION"))
            kind = F.when(note, "note").when(style, "style").when(region, "region")
            name = F.when(x["arrow"] & ~fresh, F.get(ls, i - 1)["text"])
            return F.struct(x["raw"].alias("raw"), x["line"].alias("line"), x["text"].alias("text"), x["arrow"].alias("arrow"), x["timed"].alias("timed"), kind.alias("kind"), name.alias("name"))

        return F.transform(ls, mark)

    def sealed(ls: Column) -> Column:
        opens = first_place(ls, lambda x: x["kind"].isNotNull())
        cue = first_place(ls, lambda x: x["timed"])
        return F.struct(ls.alias("ls"), F.when((cue > 0) & ((opens == 0) | (cue < opens)), cue).otherwise(0).alias("cue"))

    lines = F.transform(F.when(header, F.slice(raws, F.lit(2), F.greatest(F.size(raws), F.lit(1)))).otherwise(raws), line)
    return let(let(lines, marked), sealed)


def _blocks(ls: Column, barred: Column, cue: Column) -> Column:
    """The blocks of a paragraph.  ``barred`` says that a cue came in an
    earlier paragraph, ``cue`` where the first one of all stands in this (0: elsewhere)."""

    def cut(opens: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: ((opens == 0) | (i <= opens)) & (F.get(ls, i - 1)["arrow"] | (i == opens)))

        def block(i: Column, nth: Column, starts: Column) -> Column:
            x = F.get(ls, i - 1)
            opened = i == opens
            kind = F.when(opened, x["kind"]).when(x["timed"], "cue").otherwise("none")
            inline = trim_start_white(F.substring(x["text"], 6, 1 << 30))
            end = F.substring(x["raw"], F.length(x["line"]) + 1, F.length(x["raw"]))
            first = F.when((kind == "note") & (inline != ""), F.array(F.concat(inline, end))).otherwise(F.array().cast("array<string>"))
            until = F.coalesce(F.get(starts, nth + 1) - 1, F.size(ls))
            rest = F.transform(F.slice(ls, i + 1, until - i), lambda r: r["raw"])
            cue = kind == "cue"
            stamp = lambda g: F.when(cue, let(F.regexp_extract(x["line"], TIMING, g), times.vtt))
            body = body_of(F.concat(first, rest), lone_cr=True)
            # Made here, within the row, so that whatever reads the fields of a block finds them made.
            return let(stamp(1), lambda a: let(stamp(2), lambda b: let(body, lambda text: F.struct(
                kind.alias("block_type"), F.when(cue, x["name"]).alias("identifier"), a.alias("start"), b.alias("end"), times.total(a).alias("start_ms"), times.total(b).alias("end_ms"),
                F.when(cue, cue_settings(F.regexp_replace(x["line"], TIMING, ""))).alias("settings"), F.when(kind != "region", text).alias("body"), F.when(kind == "region", region_settings(text)).alias("region"),
                F.lit(None).cast("string").alias("error"),
            ).cast(BLOCK))))

        return let(begins, lambda starts: F.transform(starts, lambda i, nth: block(i, nth, starts)))

    def opens_at(places: Column) -> Column:
        return F.coalesce(F.get(places, F.lit(0)), F.lit(0))

    may = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.coalesce((F.get(ls, i - 1)["kind"] == "note") | (F.get(ls, i - 1)["kind"].isNotNull() & ~barred & ((cue == 0) | (i < cue))), F.lit(False)))
    return F.when(F.size(ls) > 0, let(let(may, opens_at), cut)).otherwise(F.array().cast(f"array<{BLOCK}>"))


def signature_error(content: Column) -> Column:
    sign = without_bom(F.regexp_extract(content, r"^[^\r\n]*", 0))
    return F.when(~sign.startswith("WEBVTT"), "MissingSignature").when(~sign.rlike(SIGNATURE), "InvalidSignature")


def paragraphs(content: Column, head: Column) -> Column:
    """The paragraphs of a text, the first of which is the header where ``head`` says so."""
    return F.transform(F.regexp_extract_all(content, F.lit(PARAGRAPH), F.lit(1)), lambda p, i: _placed(raw_lines(p, lone_cr=True), (i == 0) & head))


def told(rows: DataFrame, paras: str, out: str, error: Column, barred: Column) -> DataFrame:
    """``rows`` with ``out`` in place of ``paras``: blocks, or the error alone.
    ``barred`` says that a cue came before the paragraphs."""
    others = [c for c in rows.columns if c != paras]
    rows = rows.withColumn("_cue", first_place(F.col(paras), lambda p: p["cue"] > 0))
    each = F.transform(paras, lambda p, i: _blocks(p["ls"], barred | ((F.col("_cue") > 0) & (F.col("_cue") <= i)), F.when(F.col("_cue") == i + 1, p["cue"]).otherwise(0)))
    fault = F.from_json(F.to_json(F.struct(error.alias("error"))), BLOCK)
    found = F.when(error.isNotNull(), F.array(fault)).otherwise(F.filter(F.flatten(each), lambda b: b["block_type"] != "none"))
    return rows.select(*others, found.alias(out))


FIELDS = ("block_type", "identifier", "start", "end", "start_ms", "end_ms", "settings", "body", "region", "error")


def parse_vtt(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, content)`` -> one row per block, and one per document in error.

    ``(doc_id, ordinal, block_type, identifier, start, end, start_ms, end_ms,
    settings, body, region, error)`` with ``block_type`` cue, note, style or
    region.  Rows of one ``doc_id`` are read apart; null contents have no rows;
    an empty one lacks its signature.
    """
    rows = docs.where(F.col("content").isNotNull()).select("doc_id", "content", signature_error(F.col("content")).alias("error"))
    rows = rows.select("doc_id", "error", F.when(F.col("error").isNull(), paragraphs(F.col("content"), F.lit(True))).alias("_ps"))
    out = exploded(told(rows, "_ps", "_bs", F.col("error"), F.lit(False)).select("doc_id", "_bs"), "_bs", "ordinal", "b")
    return out.select("doc_id", "ordinal", *[f"b.{c}" for c in FIELDS])


def show_number(x: Column) -> Column:
    """A double without an exponent, and without a point where it is whole."""
    text = x.cast("string")
    digits, power = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0?$|\.", ""), F.regexp_extract(text, r"E-([0-9]+)$", 1).try_cast("int")
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), power - 1), digits)
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).when(power.isNotNull(), small).otherwise(text)


def show_percentage(x: Column) -> Column:
    return F.concat(show_number(x), F.lit("%"))


def format_cue_settings(s: Column) -> Column:
    def keyed(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}:"), value))

    value = F.coalesce(show_percentage(s["line"]["pct"]), s["line"]["num"].cast("string"))
    line = F.concat_ws(",", value, s["line"]["align"])
    position = F.concat_ws(",", show_percentage(s["position"]["pct"]), s["position"]["align"])
    return F.concat_ws(
        " ", keyed("vertical", s["vertical"]), keyed("line", F.when(s["line"].isNotNull(), line)), keyed("position", F.when(s["position"].isNotNull(), position)), keyed("size", show_percentage(s["size"])),
        keyed("align", s["align"]), keyed("region", s["region"]),
    )


def format_region(r: Column) -> Column:
    """The keys that differ from the defaults, one a line."""
    at = lambda a: F.concat(show_percentage(a["x"]), F.lit(","), show_percentage(a["y"]))
    plain = lambda a: (a["x"] == 0) & (a["y"] == 100)
    return F.concat_ws(
        "\n",
        F.when(r["id"] != "", F.concat(F.lit("id:"), r["id"])),
        F.when(r["width"] != 100, F.concat(F.lit("width:"), show_percentage(r["width"]))),
        F.when(r["lines"] != 3, F.concat(F.lit("lines:"), r["lines"].cast("string"))),
        F.when(~plain(r["region_anchor"]), F.concat(F.lit("regionanchor:"), at(r["region_anchor"]))),
        F.when(~plain(r["viewport_anchor"]), F.concat(F.lit("viewportanchor:"), at(r["viewport_anchor"]))),
        F.when(r["scroll"].isNotNull(), F.concat(F.lit("scroll:"), r["scroll"])),
    )


def signature(header: str | None) -> str:
    return "WEBVTT\n" if header is None else f"WEBVTT {header}\n"


def block_text(with_nodes: bool) -> Column:
    """A block as it stands in a file."""
    c = F.col
    settings = F.when(c("settings").isNotNull(), F.concat(F.lit(" "), format_cue_settings(c("settings")))).otherwise("")
    text = lambda t: F.when(t != "", F.concat(t, F.lit("\n"))).otherwise("")
    body = F.when(c("nodes").isNotNull(), serialize(c("nodes"))).otherwise(c("body")) if with_nodes else c("body")
    cue = F.concat(F.coalesce(F.concat(c("identifier"), F.lit("\n")), F.lit("")), times.encode_vtt(c("start")), F.lit(" --> "), times.encode_vtt(c("end")), settings, F.lit("\n"), text(body))
    shown = F.when(c("block_type") == "cue", cue).when(c("block_type") == "region", F.concat(F.lit("REGION\n"), text(format_region(c("region")))))
    return shown.otherwise(F.concat(F.upper("block_type"), F.lit("\n"), text(c("body"))))


def write_vtt(blocks: DataFrame, header: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Blocks as ``parse_vtt`` gives them -> ``(doc_id, content)``: the
    signature, then each block after a blank line.  Every document of
    ``docs(doc_id)`` has a row, with the signature alone where it has no
    blocks.  A cue with ``nodes`` (``vtt_text.tree``) is written from these in
    place of its body."""
    each = F.sort_array(F.collect_list(F.struct("ordinal", F.concat(F.lit("\n"), block_text("nodes" in blocks.columns)).alias("text"))))
    sign = signature(header)
    return with_all(blocks.groupBy("doc_id").agg(F.concat(F.lit(sign), F.array_join(F.transform(each, lambda x: x["text"]), "")).alias("content")), docs, sign)
