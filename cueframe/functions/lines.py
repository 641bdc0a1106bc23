"""Lines of a document, and the trims that formats ask for.

A line keeps its terminator until it is judged, so that a body put together
from lines is the document's own text, carriage returns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a regex class (fixed values).
WHITE = r"\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters.
WHITE_CHARACTERS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BOM = "\ufeff"


def raw_lines(content: Column, lone_cr: bool) -> Column:
    """Lines with their terminators: LF and CRLF, and CR alone if ``lone_cr``."""
    pattern = r"([^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+)" if lone_cr else r"([^\n]*\n|[^\n]+)"
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def unterminated(line: Column, lone_cr: bool) -> Column:
    return F.regexp_replace(line, r"(?:\r\n|\r|\n)\z" if lone_cr else r"\r?\n\z", "")


def without_bom(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{BOM}+", "")


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def trim_start_white(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE_CHARACTERS))


def trim_end_white(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_CHARACTERS))


def body_of(lines: Column, lone_cr: bool) -> Column:
    """The text that raw lines (an array) span, without the last terminator."""
    return unterminated(F.array_join(lines, ""), lone_cr)


def with_all(written: DataFrame, docs: DataFrame | None, empty: str) -> DataFrame:
    """``written(doc_id, content)`` with a row for every id of ``docs``:
    ``empty`` where nothing was written."""
    if docs is None:
        return written
    return docs.select("doc_id").distinct().join(written, "doc_id", "left").select("doc_id", F.coalesce("content", F.lit(empty)).alias("content"))
