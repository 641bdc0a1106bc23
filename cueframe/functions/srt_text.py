"""SubRip cue bodies: tokens, attributes, segments and clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:[bBiIuUsS]|[fF][oO][nN][tT])"
_REST = r"(?:>|[ \t][^<>]*>)"
START, END = rf"<{_NAME}{_REST}", rf"</{_NAME}{_REST}"
BREAK = r"</?[bB][rR](?:/?>|[ \t][^<>]*>)"
CODE = r"\{\\[^{}]*\}|\{[CcFfoPSsYy]:[^{}]*\}"
#: One pass, in this order: what opens no tag or code is a single literal character.
TOKEN = rf"({START}|{END}|{BREAK}|{CODE}|[^<{{]+|<|\{{)"
#: Attributes that renderers know (fixed values).
KNOWN_ATTRIBUTES = ("color", "size", "face")


def tokens(body: Column) -> Column:
    """``array<struct<kind, tag, attributes, text>>``; ``text`` is the source slice."""

    def token(t: Column) -> Column:
        kind = F.when(t.rlike(rf"^{START}\z"), "StartTag").when(t.rlike(rf"^{END}\z"), "EndTag").when(t.rlike(rf"^{BREAK}\z"), "LineBreak")
        kind = kind.when(t.rlike(rf"^(?:{CODE})\z"), "InlineCode").otherwise("Text")
        tag = F.when(kind.isin("StartTag", "EndTag"), F.lower(F.regexp_extract(t, r"^</?([A-Za-z]+)", 1)))
        attributes = F.when(kind == "StartTag", F.regexp_replace(F.regexp_extract(t, r"(?s)^<[A-Za-z]+(.*)>\z", 1), r"^[ \t]+|[ \t]+\z", ""))
        return F.struct(kind.alias("kind"), tag.alias("tag"), attributes.alias("attributes"), t.alias("text"))

    return F.transform(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(1)), token)


def segments(body: Column) -> Column:
    return F.filter(tokens(body), lambda t: t["kind"].isin("Text", "LineBreak"))


def requires_normalization(body: Column) -> Column:
    return body.rlike(r"[<{]")


def plain_text(body: Column) -> Column:
    """Tags and codes dropped, line breaks as LF; references stay undecoded."""
    runs = F.transform(segments(body), lambda t: F.when(t["kind"] == "LineBreak", "\n").otherwise(t["text"]))
    return F.when(requires_normalization(body), F.array_join(runs, "")).otherwise(body)


def attributes(text: Column) -> Column:
    """``array<struct<name, value>>`` of a start tag's attribute text; a name
    without ``=`` has a null value, and ``=`` alone an empty one."""
    whole = r"""([^= \t][^= \t]*(?:=(?:"[^"]*"?|'[^']*'?|[^ \t]*))?|=(?:"[^"]*"?|'[^']*'?|[^ \t]*))"""

    def attribute(a: Column) -> Column:
        name = F.regexp_extract(a, r"^[^=]*", 0)
        value = F.regexp_replace(F.substring(a, F.length(name) + 2, F.length(a)), r"""^"([^"]*)"?\z|^'([^']*)'?\z""", "$1$2")
        return F.struct(name.alias("name"), F.when(F.instr(a, "=") > 0, value).alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), attribute)


def is_known(name: Column) -> Column:
    return F.lower(name).isin(*KNOWN_ATTRIBUTES)


def show_start_tag(tag: Column, attrs: Column) -> Column:
    return F.when(attrs == "", F.concat(F.lit("<"), tag, F.lit(">"))).otherwise(F.concat(F.lit("<"), tag, F.lit(" "), attrs, F.lit(">")))


def show_attribute(name: Column, value: Column) -> Column:
    """Quoted only where white space asks for it, with ``'`` around ``"``."""
    quote = F.when(F.instr(value, '"') > 0, "'").otherwise('"')
    shown = F.when(value.rlike(r"[\s]"), F.concat(quote, value, quote)).otherwise(value)
    return F.when(value.isNull(), name).otherwise(F.concat(name, F.lit("="), shown))


def show_code(code: Column) -> Column:
    """An inline code stands as it was read."""
    return code
