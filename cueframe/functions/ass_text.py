"""ASS event text: tokens, override tags, drawing mode, and clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueframe.functions.arrays import let, running

#: Override tags that renderers know (fixed values).
KNOWN_TAGS = (
    "alpha iclip xbord xshad ybord yshad blur bord clip fade fscx fscy move shad fad fax fay frx fry frz fsc fsp org pbo pos "
    "1a 1c 2a 2c 3a 3c 4a 4c an be fe fn fr fs kf ko kt K a b c i k p q r s t u"
).split()
_NAME = "|".join(sorted(KNOWN_TAGS, key=lambda t: (-len(t), t)))
#: While a closing brace is ahead, blocks are possible and a text ends before one; past the last brace only escapes end it.
TOKEN = r"(\{[^}]*\}|\\[Nnh{}]|\\|(?=[^}]*\})[^{\\]+|[^\\]+)"
_ARGS = r"(?:[^\\(]+|\([^)]*(?:\)|\z))*+"


def override_tags(block: Column) -> Column:
    """``array<struct<name, args, known>>`` of an override block's inside; what
    stands before its first tag is a comment."""
    runs = F.filter(F.regexp_extract_all(block, F.lit(rf"(\([^)]*(?:\)|\z)|\\{_ARGS})"), F.lit(1)), lambda r: r.startswith("\\"))

    def tag(r: Column) -> Column:
        rest = F.regexp_replace(r, r"^\\[ \t]*", "")
        known = F.regexp_extract(rest, f"^(?:{_NAME})", 0)
        name = F.when(known != "", known).otherwise(F.regexp_extract(rest, "^[A-Za-z]*", 0))
        return F.struct(name.alias("name"), F.substring(rest, F.length(name) + 1, F.length(rest)).alias("args"), (known != "").alias("known"))

    return F.transform(runs, tag)


def drawing_scale(block: Column) -> Column:
    """The scale that the last ``\\p`` of a block sets, 0 if it is no number; null without one."""
    scales = F.transform(F.filter(override_tags(block), lambda t: t["name"] == "p"), lambda t: F.trim(t["args"]))
    last = F.get(F.reverse(scales), F.lit(0))
    number = F.when(last.rlike(r"^\+?0*[0-9]{1,10}\z"), F.regexp_replace(last, r"^\+", "").try_cast("long"))
    return F.when(last.isNotNull(), F.coalesce(F.when(number < 1 << 32, number), F.lit(0)))


def tokens(text: Column) -> Column:
    """``array<struct<kind, text>>`` with kind Text, EscapedBrace, HardBreak,
    SoftBreak, HardSpace, Override or Drawing; a block's text is its inside."""
    block = lambda t: t.rlike(r"^\{[^}]*\}\z")
    inside = lambda t: F.regexp_replace(t, r"^\{|\}\z", "")

    def step(drawing: Column, t: Column) -> Column:
        # Only blocks with a \p can turn drawing on or off.
        return F.when(t.rlike(r"^\{[^}]*\\[ \t]*p[^}]*\}\z"), F.coalesce(drawing_scale(inside(t)) > 0, drawing)).otherwise(drawing)

    def token(t: Column, drawing: Column) -> Column:
        kind = (
            F.when(block(t), "Override").when(drawing, "Drawing").when(t == "\\N", "HardBreak").when(t == "\\n", "SoftBreak").when(t == "\\h", "HardSpace")
            .when(t.isin("\\{", "\\}"), "EscapedBrace").otherwise("Text")
        )
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "Override", inside(t)).when(k == "EscapedBrace", F.substring(t, 2, 1)).otherwise(t).alias("text")))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda ts: F.zip_with(ts, running(ts, F.lit(False), step, "boolean"), token))


def segments(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t["kind"].isin("Override", "Drawing"))


def requires_normalization(text: Column) -> Column:
    return text.rlike(r"[{\\]")


def plain_text(text: Column) -> Column:
    """Breaks as LF, hard spaces as U+00A0, escaped braces bare; no blocks, no drawings."""
    shown = lambda t: F.when(t["kind"].isin("HardBreak", "SoftBreak"), "\n").when(t["kind"] == "HardSpace", " ").otherwise(t["text"])
    return F.when(requires_normalization(text), F.array_join(F.transform(segments(text), shown), "")).otherwise(text)


def show_tag(name: Column, args: Column) -> Column:
    return F.concat(F.lit("\\"), name, args)


def show_block(inside: Column) -> Column:
    """An override block as it stands in a text."""
    return F.concat(F.lit("{"), inside, F.lit("}"))
