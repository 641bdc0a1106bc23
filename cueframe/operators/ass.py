"""ASS/SSA scripts as rows, and back.

Every meaningful line is one block.  A line needs only the section it stands in
and the columns last declared there, both carried along by a running fold
within the document's row: nothing is shuffled, and rows of one id are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.functions import times
from cueframe.functions.arrays import exploded, first_place, let, running
from cueframe.functions.lines import raw_lines, trim_end_white, trim_start_white, trim_white, unterminated, with_all, without_bom
from cueframe.plans.options import EVENT_FIELDS, AssOptions, EventFormat, event_format

#: Canonical names (fixed values).
SECTIONS = ("Script Info", "V4 Styles", "V4+ Styles", "Events", "Fonts", "Graphics")
EVENT_KINDS = ("Dialogue", "Comment", "Picture", "Sound", "Movie", "Command")
NUMBERS = {"ReadOrder": "read_order", "Layer": "layer", "MarginL": "margin_l", "MarginR": "margin_r", "MarginV": "margin_v"}
TIMES = {"Start": "start", "End": "end"}
WORDS = {"Marked": "marked", "Style": "style", "Name": "name", "Effect": "effect"}


def canonical(name: Column, names: tuple[str, ...]) -> Column:
    """The known name that equals this one but for ASCII case, or null."""

    def known(low: Column) -> Column:
        found = F.lit(None).cast("string")
        for n in names:
            found = F.when(low == n.lower(), n).otherwise(found)
        return found

    return let(F.lower(name), known)


def split_fields(value: Column) -> Column:
    """The trimmed columns of a Format or Style row."""
    return F.transform(F.split(value, ","), trim_white)


def _number(text: Column, field: str) -> Column:
    sign = "[+-]?" if field == "Layer" else r"\+?"
    low, high = (-(2**31), 2**31 - 1) if field == "Layer" else (0, 2**32 - 1)

    def number(t: Column) -> Column:
        return F.when(t.rlike(rf"^{sign}0*[0-9]{{1,18}}\z"), F.ltrim(t, F.lit("+")).try_cast("long"))

    return let(let(text, number), lambda v: F.when(v.between(low, high), v))


def _time_problem(t: Column) -> Column:
    """Why a text is no timestamp, or null."""
    good = times.ass(t).isNotNull()
    return (
        F.when(t.isNull() | good, None)
        .when(F.octet_length(t) < 10, "InvalidTimestamp.InvalidLength")
        .when(~t.rlike(r"(?s):..:..\...\z"), "InvalidTimestamp.InvalidFormat")
        .when(~t.rlike(r":[0-9]{2}:[0-9]{2}\.[0-9]{2}\z"), "InvalidTimestamp.InvalidDigits")
        .when(~t.rlike(r":[0-5][0-9]\.[0-9]{2}\z"), "ParseSecond.Overflow")
        .when(~t.rlike(r":[0-5][0-9]:[0-9]{2}\.[0-9]{2}\z"), "ParseMinute.Overflow")
        .otherwise("ParseHour.ParseInt")
    )


def split_row(row: Column, columns: Column) -> Column:
    """The cells of a row under an array of column names; the last column takes
    the rest of the row."""
    return F.split(row, ",", F.greatest(F.size(columns), F.lit(1)))


def _value(cell: Column) -> Column:
    return let(trim_white(cell), lambda t: F.when(t != "", t))


def event_error(cells: Column, columns: Column, options: AssOptions = AssOptions()) -> Column:  # noqa: B008
    """Why the cells of a row are no event, or null."""
    unsigned = [f for f in NUMBERS if f != "Layer"]

    def problem(field: Column, cell: Column) -> Column:
        def told(v: Column) -> Column:
            wrong = F.when(field == "Layer", _number(v, "Layer").isNull()).when(field.isin(*unsigned), _number(v, "ReadOrder").isNull())
            return F.when(v.isNotNull(), F.when(wrong, F.concat(F.lit("InvalidField("), field, F.lit(")"))).when(field.isin(*TIMES), _time_problem(v)))

        return F.when(field.isin(*NUMBERS, *TIMES), let(_value(cell), told))

    n = F.size(columns)
    error = F.when(n == 0, "MissingFormat")
    if not options.allow_malformed_fields:
        first = F.get(F.filter(F.zip_with(columns, cells, problem), lambda e: e.isNotNull()), F.lit(0))
        error = F.coalesce(error, first)
    if not options.allow_short_event:
        error = F.coalesce(error, F.when(F.size(cells) < n, F.concat(F.lit("TooFewFields("), n.cast("string"), F.lit(","), F.size(cells).cast("string"), F.lit(")"))))
    return error


def event_of(kind: Column, row: Column, cells: Column, columns: Column) -> Column:
    """The event struct of a row's cells: ``Text`` is verbatim, other fields
    are trimmed, and empty ones null."""

    def made(cells: Column) -> Column:
        cell = {f: F.get(cells, (F.array_position(columns, f) - 1).cast("int")) for f in EVENT_FIELDS}
        return F.struct(
            kind.alias("kind"),
            *[_number(_value(cell[f]), f).alias(c) for f, c in NUMBERS.items()],
            *[let(_value(cell[f]), lambda v: F.when(v.isNotNull(), times.ass(v))).alias(c) for f, c in TIMES.items()],
            *[_value(cell[f]).alias(c) for f, c in WORDS.items()],
            F.coalesce(cell["Text"], F.lit("")).alias("text"),
            row.alias("row"),
            F.size(columns).alias("columns"),
        )

    return let(cells, made)


def parse_event(kind: Column, row: Column, columns: Column, options: AssOptions = AssOptions()) -> tuple[Column, Column]:  # noqa: B008
    """``(event struct, error)`` of a row under an array of column names."""
    cells = split_row(row, columns)
    return event_of(kind, row, cells, columns), let(cells, lambda c: event_error(c, columns, options))


def parse_event_line(line: Column, columns: Column, options: AssOptions = AssOptions()) -> tuple[Column, Column]:  # noqa: B008
    """The same of a line with its keyword, as ``Dialogue: 0,...``; a line
    without a known one is ``UnexpectedLine``."""
    def read(text: Column) -> Column:
        colon = F.instr(text, ":")
        kind = F.when(colon > 0, canonical(trim_end_white(F.substring_index(text, ":", 1)), EVENT_KINDS))
        row = F.ltrim(F.substring(text, colon + 1, F.length(text)), F.lit(" \t"))
        return let(F.struct(kind.alias("kind"), row.alias("row")), lambda x: let(split_row(x["row"], columns), lambda cells: told(x, cells)))

    def told(x: Column, cells: Column) -> Column:
        error = F.when(x["kind"].isNull(), "UnexpectedLine").otherwise(event_error(cells, columns, options))
        return let(error, lambda e: F.struct(F.when(e.isNull(), event_of(x["kind"], x["row"], cells, columns)).alias("event"), e.alias("error")))

    both = let(trim_start_white(line), read)
    return both["event"], both["error"]


def event_field(event: Column, index: Column) -> Column:
    """The untrimmed column of an event's row."""
    return F.get(F.split(event["row"], ",", F.greatest(event["columns"], F.lit(1))), index)


STATE = "struct<section:string,format:array<string>>"


def _line(text: Column, line: Column) -> Column:
    """What a line tells without its section."""

    def closed(bare: Column) -> Column:
        return F.when(bare.endswith("]"), F.substring(bare, F.lit(2), F.length(bare) - 2))

    opened = F.when(text.startswith("["), let(let(trim_end_white(text), closed), lambda name: F.coalesce(canonical(name, SECTIONS), name)))
    colon = F.instr(text, ":")
    key = F.when(colon > 0, trim_end_white(F.substring(text, F.lit(1), colon - 1)))
    value = F.when(colon > 0, F.ltrim(F.substring(text, colon + 1, F.length(text)), F.lit(" \t")))
    return F.struct(line.alias("line"), text.alias("text"), opened.alias("opened"), key.alias("key"), value.alias("value"))


def lines_of(content: Column, head: Column) -> Column:
    """The lines of a text that are not blank; a byte order mark goes where the text is the ``head`` of its document."""
    whole = F.transform(raw_lines(content, lone_cr=True), lambda r, i: let(unterminated(r, lone_cr=True), lambda x: F.when((i == 0) & head, without_bom(x)).otherwise(x)))
    return F.filter(F.transform(whole, lambda x: let(trim_start_white(x), lambda t: _line(t, x))), lambda x: trim_end_white(x["text"]) != "")


def declares(x: Column) -> Column:
    """Does a line name the columns of events, if it stands among them?"""
    return F.coalesce(F.lower(x["key"]) == "format", F.lit(False)) & ~x["text"].startswith("[") & ~x["text"].startswith(";")


def told(rows: DataFrame, lines: str, out: str, before: Column, options: AssOptions) -> DataFrame:
    """``rows`` with ``out`` in place of ``lines``: blocks and the error, if
    any, that ends them.  ``before`` is the section and the columns that the lines come in."""
    none = F.lit(None).cast("array<string>")
    begin = F.array().cast("array<string>") if not options.allow_missing_format else EventFormat.ass().column()

    def step(s: Column, x: Column) -> Column:
        entered = F.struct(x["opened"].alias("section"), none.alias("format")).cast(STATE)
        declared = F.struct(s["section"].alias("section"), event_format(x["value"]).alias("format")).cast(STATE)
        return F.when(x["opened"].isNotNull(), entered).when((s["section"] == "Events") & declares(x), declared).otherwise(s)

    others = [c for c in rows.columns if c != lines]
    rows = rows.withColumn("_ss", running(F.col(lines), before, step, STATE))

    def judged(x: Column, s: Column) -> Column:
        return let(F.coalesce(x["opened"], s["section"]), lambda section: let(kind_of(x, section), lambda k: known(x, s, section, k)))

    def kind_of(x: Column, section: Column) -> Column:
        mark = F.when(section == "Fonts", "fontname:").when(section == "Graphics", "filename:")
        styled = section.isin("V4 Styles", "V4+ Styles") | (~section.isin(*SECTIONS) & F.lower(trim_end_white(section)).endswith("styles"))
        text, key = x["text"], x["key"]
        kind = F.when(x["opened"].isNotNull(), "section").when(text.startswith("["), "unclosed").when(mark.isNotNull() & ~text.startswith(mark), "data")
        kind = kind.when(text.startswith(";"), "comment").when(F.coalesce(key, F.lit("")) == "", "unexpected").when(F.lower(key) == "format", "format")
        kind = kind.when((F.lower(key) == "style") & styled, "style").when((section == "Events") & F.lower(key).isin(*map(str.lower, EVENT_KINDS)), "event")
        return kind.otherwise("property")

    def known(x: Column, s: Column, section: Column, k: Column) -> Column:
        def of_event(columns: Column) -> Column:
            return let(split_row(x["value"], columns), lambda c: F.struct(event_of(canonical(x["key"], EVENT_KINDS), x["value"], c, columns).alias("event"), event_error(c, columns, options).alias("error")))

        read = F.when(k == "event", let(F.coalesce(s["format"], begin), of_event))
        return let(read, lambda e: F.struct(
            k.alias("kind"), section.alias("section"), x["text"].alias("text"), x["line"].alias("line"), x["key"].alias("key"), x["value"].alias("value"), e["event"].alias("event"),
            F.when(k == "unclosed", "UnclosedSection").when(k == "unexpected", "UnexpectedLine").otherwise(e["error"]).alias("error"),
        ))

    found = F.zip_with(lines, "_ss", judged)
    if options.ignore_unknown_lines:
        found = F.filter(found, lambda x: ~x["kind"].isin("unclosed", "unexpected"))
    rows = rows.select(*others, found.alias("_bs")).withColumn("_stop", first_place(F.col("_bs"), lambda x: x["error"].isNotNull()))
    return rows.select(*others, F.when(F.col("_stop") > 0, F.slice("_bs", F.lit(1), F.col("_stop"))).otherwise(F.col("_bs")).alias(out))


def start_state() -> Column:
    return F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("array<string>").alias("format"))


def block_fields() -> list[Column]:
    """The columns of a block, from those of ``told``."""
    ok, kind = F.col("error").isNull(), F.col("kind")
    text = F.when(kind == "comment", F.substring("text", 2, 1 << 30)).when(kind == "data", F.col("line")).when(kind.isin("format", "style"), F.col("value"))
    plain = kind == "property"
    return [
        F.when(ok, kind).alias("block_type"),
        F.when(ok, F.col("section")).alias("section"),
        F.when(ok, text).alias("text"),
        F.when(ok & plain, F.col("key")).alias("key"),
        F.when(ok & plain, F.col("value")).alias("value"),
        F.when(ok & (kind == "format"), event_format(F.col("value"))).alias("format"),
        F.when(ok, F.col("event")).alias("event"),
        F.col("error"),
    ]


def parse_ass(docs: DataFrame, options: AssOptions = AssOptions()) -> DataFrame:  # noqa: B008
    """``docs(doc_id, content)`` -> one row per block, and one per document in error.

    ``(doc_id, ordinal, block_type, section, text, key, value, format, event, error)``:
    block_type section, comment, format, style, event, data or property;
    ``text`` is the comment, payload, style row or declared format.
    Rows of one ``doc_id`` are read apart; null and empty contents have no rows.
    """
    rows = docs.select("doc_id", lines_of(F.col("content"), F.lit(True)).alias("_ls"))
    out = exploded(told(rows, "_ls", "_bs", start_state(), options), "_bs", "ordinal", "b")
    return out.select("doc_id", "ordinal", "b.*").select("doc_id", "ordinal", *block_fields())


def encode_event(event: Column, columns: Column) -> Column:
    """An event line under an array of column names; a column without a known
    name repeats what the row held there."""

    def cell(field: Column, at: Column) -> Column:
        shown = F.when(field == "Text", event["text"])
        for f, c in NUMBERS.items():
            shown = shown.when(field == f, event[c].cast("string"))
        for f, c in TIMES.items():
            shown = shown.when(field == f, times.encode_ass(event[c]))
        for f, c in WORDS.items():
            shown = shown.when(field == f, event[c])
        return F.coalesce(F.when(field.isNull(), F.when(event["row"] != "", event_field(event, at))).otherwise(shown), F.lit(""))

    return F.concat(event["kind"], F.lit(": "), F.array_join(F.transform(columns, cell), ","))


def block_lines(blocks: DataFrame, default_format: EventFormat | None = None) -> DataFrame:
    """Blocks with ``line``, as it stands in a file under the columns in effect."""
    default = (default_format or EventFormat.ass()).column()
    by_doc = Window.partitionBy("doc_id").orderBy("ordinal")
    kind = F.col("block_type")
    rows = blocks.withColumn("_segment", F.count(F.when(kind == "section", 1)).over(by_doc))
    segment = Window.partitionBy("doc_id", "_segment").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_columns", F.coalesce(F.last(F.when((kind == "format") & (F.col("section") == "Events"), F.col("format")), ignorenulls=True).over(segment), default))
    line = F.when(kind == "section", F.concat(F.when(F.col("ordinal") > 0, "\n").otherwise(""), F.lit("["), F.col("section"), F.lit("]")))
    line = line.when(kind == "comment", F.concat(F.lit(";"), F.col("text"))).when(kind == "format", F.concat(F.lit("Format: "), F.col("text"))).when(kind == "style", F.concat(F.lit("Style: "), F.col("text")))
    line = line.when(kind == "data", F.col("text")).when(kind == "event", encode_event(F.col("event"), F.col("_columns"))).otherwise(F.concat(F.col("key"), F.lit(": "), F.col("value")))
    return rows.withColumn("line", F.concat(line, F.lit("\n"))).drop("_segment", "_columns")


def write_ass(blocks: DataFrame, default_format: EventFormat | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Blocks as ``parse_ass`` gives them -> ``(doc_id, content)``: LF only, a
    blank line before every section but a first line.  Every document of
    ``docs(doc_id)`` has a row, empty where it has no blocks."""
    each = F.sort_array(F.collect_list(F.struct("ordinal", "line")))
    return with_all(block_lines(blocks, default_format).groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["line"]), "").alias("content")), docs, "")
