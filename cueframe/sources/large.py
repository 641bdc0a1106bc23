"""Documents larger than a task, read and written in parts.

Spark's text source cuts files into byte ranges and deals their lines to many
tasks, in any store that Spark reads.  Each task packs the lines of a range
into parts that end where a parser may start anew: after a blank line, or for
scripts after any line.  What lies before the first and after the last such
place of a range, less than a paragraph each, is joined with the neighbouring
ranges'; no other text is shuffled.

What a part does to the state of a parser is a function that composes: the
greatest index so far, whether a cue came, the section and the columns in
effect.  These are folded over the parts, as rows of a few numbers, so that
every part is parsed with the state that the parts before it leave; in the same
way its rows are numbered, and left out behind an error.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.functions.arrays import exploded, first_place
from cueframe.operators import ass, srt, vtt
from cueframe.plans.options import AssOptions, EventFormat, SrtOptions

#: Bytes of text that are parsed as one row, at least.
PART_BYTES = 1 << 18
#: Rows that are broadcast at most: one per part, or per document.
BROADCAST_ROWS = 1 << 17
HEAD, TAIL, WHOLE = 0, 1, 2
_LAST = 1 << 30
KEYS = ["doc_id", "block", "nth"]
_PARTS = "doc_id string, block struct<file:string,start:long>, nth int, edge int, content string"


def _packed(cut: str, part_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of byte ranges, in order, to parts and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, buffer, size, upto, nth, begun = None, [], 0, 0, 0, False

        def closed() -> None:
            """The end of a range."""
            nonlocal nth
            if cut == "blank" and begun:
                if upto:
                    out.append((*key, nth, None, b"".join(buffer[:upto])))
                if buffer[upto:]:
                    out.append((*key, _LAST, TAIL, b"".join(buffer[upto:])))
            elif buffer:
                out.append((*key, nth, WHOLE if cut == "blank" else None, b"".join(buffer)))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc, file, start, line in zip(*columns, strict=True):
                if key != (doc, file, start):
                    if key is not None:
                        closed()
                    key, buffer, size, upto, nth, begun = (doc, file, start), [], 0, 0, 0, cut == "line"
                buffer.append(line + b"\n")
                size += len(line) + 1
                if cut == "line" or line in (b"", b"\r"):
                    upto = len(buffer)
                    if not begun or size >= part_bytes:
                        out.append((*key, nth, None if begun else HEAD, b"".join(buffer)))
                        buffer, size, upto, nth, begun = [], 0, 0, nth + 1, True
                if len(out) >= 16:
                    yield _batch(out)
                    out.clear()
        if key is not None:
            closed()
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, file, start, nth, edge, content = zip(*rows, strict=True) if rows else [()] * 6
    arrays = [pa.array(doc, pa.string()), pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(nth, pa.int32()), pa.array(edge, pa.int32()), pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "file", "start", "nth", "edge", "content"])


def read_parts(spark: SparkSession, path: str, glob: str = "*", cut: str = "blank", part_bytes: int = PART_BYTES, staging: str | None = None) -> DataFrame:
    """``(doc_id, block, nth, head, content)``: the parts of each file of a
    folder, in the order of ``block`` and ``nth``; ``head`` marks the first.

    A folder ``doc_id=...`` is one document, its files in the order of their
    names; other files are documents by their paths.  ``cut`` is ``blank`` or
    ``line``.  Lines end with LF; a last line has one added; a text without
    blank lines is one part.  Empty documents are one empty part.  With
    ``staging`` the parts are written there once and read from there, so that
    the files are read once however often the parts are.
    """
    source = spark.read.option("pathGlobFilter", glob)
    listed = source.format("binaryFile").load(path)
    folders = "doc_id" in listed.columns
    if not folders:
        source = source.option("recursiveFileLookup", "true")
        listed = source.format("binaryFile").load(path)
    doc = F.col("doc_id").cast("string") if folders else F.col("_metadata.file_path")
    file = F.col("_metadata.file_name") if folders else F.lit("")
    lines = source.option("lineSep", "\n").text(path).select(doc.alias("doc_id"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    raw = lines.mapInArrow(_packed(cut, part_bytes), "doc_id string, file string, start long, nth int, edge int, content binary")
    parts = raw.select("doc_id", F.struct("file", "start").alias("block"), "nth", "edge", F.col("content").cast("string").alias("content"))
    if staging is not None:
        parts.write.option("compression", "zstd").parquet(staging)
        parts = spark.read.schema(_PARTS).parquet(staging)
    edges = parts.where(F.col("edge").isNotNull())
    # An edge belongs to the paragraph that the last head before it closed.
    before = Window.partitionBy("doc_id").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    grouped = edges.withColumn("group", F.coalesce(F.sum(F.when(F.col("edge") == HEAD, 1).otherwise(0)).over(before), F.lit(0))).groupBy("doc_id", "group")
    each = F.sort_array(F.collect_list(F.struct("block", "nth", "content")))
    joined = grouped.agg(F.min(F.struct("block", "nth")).alias("at"), F.array_join(F.transform(each, lambda x: x["content"]), "").alias("content"))
    whole = parts.where(F.col("edge").isNull()).select(*KEYS, "content").unionByName(joined.select("doc_id", "at.block", "at.nth", "content"))
    # Which file a document begins with, and documents without a line.
    names = listed.select(doc.alias("doc_id"), file.alias("file"), "length").groupBy("doc_id").agg(F.min(F.when(F.col("length") > 0, F.col("file"))).alias("first"))
    none = names.where(F.col("first").isNull()).select("doc_id", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start")).alias("block"), F.lit(0).alias("nth"), F.lit(True).alias("head"), F.lit("").alias("content"))
    at_top = (F.col("block.start") == 0) & (F.col("nth") == 0)
    if folders:
        headed = whole.join(_few(names)(names), "doc_id").withColumn("head", at_top & (F.col("block.file") == F.col("first")))
    else:
        headed = whole.withColumn("head", at_top)
    return headed.select(*KEYS, "head", "content").unionByName(none)


def _few(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to join a table that has no more rows than ``rows``: broadcast if
    those are few, else as Spark sees fit.  ``rows`` are counted, once."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast if few else lambda table: table


def _before(parts: DataFrame, **folds: str) -> DataFrame:
    """The keys of parts, and each column folded over the parts before:
    ``sum``, ``max`` or ``last`` (of what is not null).  Folded within blocks
    and over blocks, so that no task takes in more than a document's blocks."""
    within = Window.partitionBy("doc_id", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    make = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("nth")))}
    inner = parts.select(*KEYS, *(make[how](c).over(within).alias(f"{c}_in") for c, how in folds.items()))
    blocks = parts.groupBy("doc_id", "block").agg(*(total[how](c).alias(c) for c, how in folds.items()))
    outer = blocks.select("doc_id", "block", *(make[how](c).over(over).alias(f"{c}_out") for c, how in folds.items()))

    def both(c: str, how: str) -> Column:
        a, b = F.col(f"{c}_in"), F.col(f"{c}_out")
        return {"sum": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest(a, b), "last": F.coalesce(a, b)}[how].alias(c)

    return inner.join(outer, ["doc_id", "block"]).select(*KEYS, *(both(c, how) for c, how in folds.items()))


def _rows(parsed: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(doc_id, ordinal, e)`` from parts with ``es``, arrays of rows: numbered
    through, up to a document's first error."""
    sizes = parsed.select(*KEYS, F.size("es").cast("long").alias("n"), F.exists("es", lambda e: e["error"].isNotNull()).cast("int").alias("failed"))
    offsets = _before(sizes, n="sum", failed="max")
    kept = parsed.join(small(offsets), KEYS).where(F.coalesce(F.col("failed"), F.lit(0)) == 0)
    return exploded(kept.select("doc_id", "n", "es"), "es", "at", "e").select("doc_id", (F.col("n") + F.col("at")).alias("ordinal"), "e")


def parse_srt_parts(parts: DataFrame, options: SrtOptions = SrtOptions()) -> DataFrame:  # noqa: B008
    """The rows of ``parse_srt`` from parts; ``ordinal`` is a long."""
    small = _few(parts.select(*KEYS))
    known = parts.select(*KEYS, srt.paragraphs(F.col("content"), options).alias("ps"))
    if options.monotonic_index:
        most = known.select(*KEYS, F.array_max(F.transform(F.filter("ps", lambda p: p["complete"] & p["numbered"]), lambda p: p["index"])).alias("last"))
        known = known.join(small(_before(most, last="max")), KEYS)
    else:
        known = known.withColumn("last", F.lit(None).cast("decimal(20,0)"))
    parsed = srt.told(known, "ps", "es", F.coalesce(F.col("last"), F.lit(0)), options)
    return _rows(parsed, small).select("doc_id", "ordinal", *[f"e.{c}" for c in srt.FIELDS])


def parse_vtt_parts(parts: DataFrame) -> DataFrame:
    """The rows of ``parse_vtt`` from parts; ``ordinal`` is a long."""
    small = _few(parts.select(*KEYS))
    error = F.when(F.col("head"), vtt.signature_error(F.col("content")))
    known = parts.select(*KEYS, error.alias("error"), "content", "head").withColumn("ps", F.when(F.col("error").isNull(), vtt.paragraphs(F.col("content"), F.col("head")))).drop("content", "head")
    cues = known.select(*KEYS, (first_place(F.col("ps"), lambda p: p["cue"] > 0) > 0).cast("int").alias("barred"))
    known = known.join(small(_before(cues, barred="max")), KEYS)
    parsed = vtt.told(known, "ps", "es", F.col("error"), F.coalesce(F.col("barred"), F.lit(0)) > 0).select(*KEYS, "es")
    return _rows(parsed, small).select("doc_id", "ordinal", *[f"e.{c}" for c in vtt.FIELDS])


def parse_ass_parts(parts: DataFrame, options: AssOptions = AssOptions()) -> DataFrame:  # noqa: B008
    """The rows of ``parse_ass`` from parts; ``ordinal`` is a long."""
    small = _few(parts.select(*KEYS))
    known = parts.select(*KEYS, ass.lines_of(F.col("content"), F.col("head")).alias("ls"))
    kind = "struct<opened:string,format:array<string>,loose:array<string>>"

    def step(s: Column, x: Column) -> Column:
        # Columns named before any section of the part hold only if the section that it comes in has events.
        named = ass.event_format(x["value"])
        entered = F.struct(x["opened"], F.lit(None), s["loose"]).cast(kind)
        loose = F.struct(s["opened"], s["format"], named).cast(kind)
        declared = F.struct(s["opened"], named, s["loose"]).cast(kind)
        return F.when(x["opened"].isNotNull(), entered).when(~ass.declares(x), s).when(s["opened"].isNull(), loose).when(s["opened"] == "Events", declared).otherwise(s)

    begin = F.struct(F.lit(None), F.lit(None), F.lit(None)).cast(kind)
    effect = known.select(*KEYS, F.aggregate("ls", begin, step).alias("s"))
    effect = effect.select(
        *KEYS,
        F.when(F.col("s.opened").isNotNull(), F.struct("block", "nth", F.col("s.opened").alias("opened"), F.col("s.format").alias("format"))).alias("entered"),
        F.when(F.col("s.loose").isNotNull(), F.struct("block", "nth", F.col("s.loose").alias("format"))).alias("loose"),
    )
    before = _before(effect, entered="last", loose="last")
    place = lambda c: F.struct(F.col(f"{c}.block"), F.col(f"{c}.nth"))
    later = (F.col("entered.opened") == "Events") & F.col("loose").isNotNull() & (place("loose") > place("entered"))
    state = F.struct(F.col("entered.opened").alias("section"), F.when(later, F.col("loose.format")).otherwise(F.col("entered.format")).alias("format"))
    known = known.join(small(before.select(*KEYS, state.alias("before"))), KEYS)
    parsed = ass.told(known, "ls", "es", F.col("before"), options).select(*KEYS, "es")
    return _rows(parsed, small).select("doc_id", "ordinal", "e.*").select("doc_id", "ordinal", *ass.block_fields())


def read_large_srt(spark: SparkSession, path: str, options: SrtOptions = SrtOptions(), glob: str = "*", **parts) -> DataFrame:  # noqa: B008
    """The rows of ``parse_srt`` over files of any size; see ``read_parts``."""
    return parse_srt_parts(read_parts(spark, path, glob, "blank", **parts), options)


def read_large_vtt(spark: SparkSession, path: str, glob: str = "*", **parts) -> DataFrame:
    """The rows of ``parse_vtt`` over files of any size; see ``read_parts``."""
    return parse_vtt_parts(read_parts(spark, path, glob, "blank", **parts))


def read_large_ass(spark: SparkSession, path: str, options: AssOptions = AssOptions(), glob: str = "*", **parts) -> DataFrame:  # noqa: B008
    """The rows of ``parse_ass`` over files of any size; see ``read_parts``."""
    return parse_ass_parts(read_parts(spark, path, glob, "line", **parts), options)


def scratch(spark: SparkSession) -> str:
    """The folder that the session names for what driver and executors share;
    a temporary one only where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="cueframe-")


def write_rows(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """``rows(doc_id, ordinal, text)`` as a folder ``doc_id=...`` for each
    document, whose files, in the order of their names, are its rows in order.

    Rows are dealt by ranges of document and ordinal, to ``parts`` tasks or as
    the session has it, and streamed to their files; no document is gathered.
    The job's commit makes all files appear, and one that fails leaves none.
    Each row's text ends with LF, which the text sink adds.
    """
    order = ["doc_id", "ordinal"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("value")).write.partitionBy("doc_id").text(path)


def write_srt_files(entries: DataFrame, path: str, parts: int | None = None) -> None:
    """Entries to files, with the bytes of ``write_srt``."""
    firsts = entries.groupBy("doc_id").agg(F.min("ordinal").alias("first"))
    gap = F.when(F.col("ordinal") > F.col("first"), "\n").otherwise("")
    write_rows(entries.join(_few(firsts)(firsts), "doc_id").select("doc_id", "ordinal", F.concat(gap, srt.entry_text()).alias("text")), path, parts)


def write_vtt_files(blocks: DataFrame, path: str, header: str | None = None, docs: DataFrame | None = None, parts: int | None = None) -> None:
    """Blocks to files, with the bytes of ``write_vtt``."""
    heads = (blocks if docs is None else docs).select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("ordinal"), F.lit(vtt.signature(header)).alias("text"))
    rows = blocks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.concat(F.lit("\n"), vtt.block_text("nodes" in blocks.columns)).alias("text"))
    write_rows(rows.unionByName(heads), path, parts)


def write_ass_files(blocks: DataFrame, path: str, default_format: EventFormat | None = None, parts: int | None = None) -> None:
    """Blocks to files, with the bytes of ``write_ass``."""
    write_rows(ass.block_lines(blocks, default_format).select("doc_id", "ordinal", F.col("line").alias("text")), path, parts)
