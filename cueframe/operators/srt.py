"""SubRip documents as rows, and back.

After a blank line a reader is always between entries, so a document falls
into paragraphs that yield at most one entry each.  A document is read within
its row: paragraphs by one regular expression, their lines by array functions,
and what crosses paragraphs, the running index, by a running fold.  Nothing is
shuffled, and rows of one id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.functions import times
from cueframe.functions.arrays import exploded, first_place, let, running
from cueframe.functions.lines import BOM, body_of, raw_lines, unterminated, with_all, without_bom
from cueframe.plans.options import SrtOptions

ARROW = r"[ \t\f]+-->[ \t\f]+"
HEADER = rf"^{times.SRT}{ARROW}{times.SRT}"
#: A run of lines none of which is blank; possessive, so that no long run is tried twice.
PARAGRAPH = rf"((?:(?!{BOM}*(?:\r?\n|\z))[^\n]*+(?:\n|\z))++)"
TOKEN = "struct<kind:string,index:decimal(20,0),problem:string,text:string>"


def _token(text: Column) -> Column:
    """What the first token of a line is: H(eader), N(umber), or E(rror)."""

    def number(digits: Column) -> Column:
        value = F.when(F.length(digits) <= 20, digits.try_cast("decimal(38,0)"))
        most = F.lit(times.U64).cast("decimal(38,0)")
        bad = F.when(F.length(digits) > 20, "ParseIndex.Overflow").when(value == 0, "ParseIndex.Zero").when(value > most, "ParseIndex.ParseInt")
        return F.struct(F.when(bad.isNull(), "N").otherwise("E").alias("kind"), F.when(bad.isNull(), value).alias("index"), bad.alias("problem"), text.alias("text")).cast(TOKEN)

    def plain(kind: str, problem: str | None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(None).alias("index"), F.lit(problem).alias("problem"), text.alias("text")).cast(TOKEN)

    digits = F.regexp_extract(text, "^[0-9]+", 0)
    return F.when(~text.rlike("^[0-9]"), plain("E", "Unknown")).when(text.rlike(HEADER), plain("H", None)).otherwise(let(digits, number))


def _paragraph(raws: Column, options: SrtOptions) -> Column:
    """A paragraph's entry, as far as the paragraph tells."""

    def found(ls: Column, k: Column) -> Column:
        first, after, top = F.when(k > 0, F.get(ls, k - 1)), F.when(k > 0, F.get(ls, k)), F.get(ls, F.lit(0))
        numbered = F.coalesce(first["kind"] == "N", F.lit(False))
        orphaned = (k != 1) & F.lit(not options.ignore_orphan_text)
        complete = (k > 0) & ~orphaned & (~numbered | F.coalesce(after["kind"] == "H", F.lit(False)))
        body = body_of(F.slice(raws, k + F.when(numbered, 2).otherwise(1), F.greatest(F.size(raws), F.lit(1))), lone_cr=False)
        return F.struct(
            numbered.alias("numbered"), orphaned.alias("orphaned"), complete.alias("complete"), first["index"].alias("index"), F.when(orphaned, F.coalesce(top["problem"], F.lit("Unknown"))).alias("orphan"),
            F.coalesce(after["problem"], F.lit("ExpectedHeader")).alias("headless"), F.when(numbered, after["text"]).otherwise(first["text"]).alias("head"), F.when(complete, body).alias("body"),
        )

    begins = lambda x: (x["kind"] == "N") | (F.lit(options.allow_missing_index) & (x["kind"] == "H"))
    tokens = F.transform(raws, lambda r: let(without_bom(unterminated(r, lone_cr=False)), _token))
    return let(tokens, lambda ls: let(first_place(ls, begins), lambda k: found(ls, k)))


def paragraphs(content: Column, options: SrtOptions) -> Column:
    """The entries of a document's paragraphs, as far as each tells by itself."""
    return F.transform(F.regexp_extract_all(content, F.lit(PARAGRAPH), F.lit(1)), lambda p: _paragraph(raw_lines(p, lone_cr=False), options))


def told(rows: DataFrame, paras: str, out: str, last: Column, options: SrtOptions) -> DataFrame:
    """``rows`` with ``out`` in place of ``paras``: entries and the error, if
    any, that ends them.  ``last`` is the greatest index before the paragraphs."""
    zero = last.cast("decimal(20,0)")
    rows = rows.withColumn("_last", running(F.col(paras), zero, lambda last, p: F.when(p["complete"] & p["numbered"], F.greatest(last, p["index"])).otherwise(last), "decimal(20,0)"))

    def judged(p: Column, last: Column) -> Column:
        stale = p["numbered"] & ~p["orphaned"] & (p["index"] <= last) & F.lit(options.monotonic_index)
        headless = p["numbered"] & ~p["orphaned"] & ~p["complete"] & F.lit(not options.ignore_broken_header)
        error = F.when(p["orphaned"], p["orphan"]).when(stale & F.lit(not options.tolerant), "NonMonotonicIndex").when(stale, None).when(headless, p["headless"])
        last_got = F.create_map(F.lit("last"), last.cast("string"), F.lit("got"), p["index"].cast("string"))
        detail = F.when(error == "NonMonotonicIndex", last_got).when(error == "ExpectedHeader", F.create_map(F.lit("index"), p["index"].cast("string")))
        ok = error.isNull() & p["complete"] & ~stale
        stamp = lambda g: F.when(ok, let(F.regexp_extract(p["head"], HEADER, g), times.srt))
        # Made here, within the row, so that whatever reads the fields of a stamp finds it made.
        return let(stamp(1), lambda a: let(stamp(2), lambda b: F.struct(
            error.alias("error"), detail.alias("error_detail"), (p["complete"] & ~stale).alias("kept"), F.when(ok, p["index"]).alias("index"), a.alias("start"), b.alias("end"),
            times.total(a).cast("long").alias("start_ms"), times.total(b).cast("long").alias("end_ms"), F.when(ok, p["body"]).alias("body"),
        )))

    others = [c for c in rows.columns if c not in (paras, "_last")]
    rows = rows.select(*others, F.zip_with(paras, "_last", judged).alias("_es"))
    stop = first_place(F.col("_es"), lambda e: e["error"].isNotNull())
    upto = F.when(stop > 0, F.slice("_es", F.lit(1), stop)).otherwise(F.col("_es"))
    return rows.select(*others, F.filter(upto, lambda e: e["kept"] | e["error"].isNotNull()).alias(out))


FIELDS = ("index", "start", "end", "start_ms", "end_ms", "body", "error", "error_detail")


def parse_srt(docs: DataFrame, options: SrtOptions = SrtOptions()) -> DataFrame:  # noqa: B008
    """``docs(doc_id, content)`` -> one row per entry, and one per document in error.

    ``(doc_id, ordinal, index, start, end, start_ms, end_ms, body, error, error_detail)``;
    an error row has nulls but for its last columns and ends its document.
    Rows of one ``doc_id`` are read apart; a null or empty content has no rows.
    """
    rows = docs.select("doc_id", paragraphs(F.col("content"), options).alias("_ps"))
    out = exploded(told(rows, "_ps", "_es", F.lit(0), options), "_es", "ordinal", "e")
    return out.select("doc_id", "ordinal", *[f"e.{c}" for c in FIELDS])


def encode_header(index: Column, start: Column, end: Column) -> Column:
    number = F.when(index.isNotNull(), F.concat(index.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(number, times.encode_srt(start), F.lit(" --> "), times.encode_srt(end), F.lit("\n"))


def entry_text() -> Column:
    return F.concat(encode_header(F.col("index"), F.col("start"), F.col("end")), F.col("body"), F.lit("\n"))


def write_srt(entries: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Entries ``(doc_id, ordinal, index, start, end, body)`` -> ``(doc_id, content)``;
    a blank line stands between entries.  Every document of ``docs(doc_id)``
    has a row, empty where it has no entries."""
    each = F.sort_array(F.collect_list(F.struct("ordinal", entry_text().alias("text"))))
    return with_all(entries.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("content")), docs, "")
