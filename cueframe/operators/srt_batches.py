"""SubRip documents as rows, an Arrow batch at a time.

The rows of ``srt.parse_srt``, made in another way: all lines of a batch are
found, classed and numbered together in numpy arrays, paragraphs are runs of
lines, the running index is a running maximum of ranks, and bodies are slices
of the documents' bytes.  No document is looked at on its own, so many short
ones cost what one long one does.  Nothing is shuffled; a batch is cut into
slices of some megabytes, or one document, which bound a task's memory.

Spark does not see into it: filters and columns of the result are not pushed
into the parser, as they are into expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cueframe.functions import spans
from cueframe.plans.options import SrtOptions

#: What the first token of a line may be wrong in, by number; the first is a line that begins with no digit.
PROBLEMS = ("Unknown", "ParseIndex.Overflow", "ParseIndex.Zero", "ParseIndex.ParseInt")
NON_MONOTONIC, EXPECTED_HEADER = len(PROBLEMS), len(PROBLEMS) + 1
ERRORS = pa.array([*PROBLEMS, "NonMonotonicIndex", "ExpectedHeader"])
STAMP = "struct<h:decimal(20,0),m:int,s:int,f:int>"
SCHEMA = f"ordinal int, index decimal(20,0), start {STAMP}, end {STAMP}, start_ms long, end_ms long, body string, error string, error_detail map<string,string>"
NUMBER, HEADER, BAD = 1, 2, 3


def _stamp(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a timestamp begins at each place, and where its minutes' colon is."""
    digit = spans.DIGIT
    colon = at + np.where(data[at + 2] == ord(":"), 2, 3)
    ok = digit[data[at]] & digit[data[at + 1]] & ((colon == at + 2) | digit[data[at + 2]]) & (colon + 10 <= until)
    for k, want in enumerate(":50:50,000"):
        got = data[colon + k]
        ok &= got == ord(want) if want in ":," else digit[got] & ((want == "0") | (got <= ord("5")))
    return ok, colon


def _header(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a timing begins at each place, and where its second stamp is."""
    ok, colon = _stamp(data, at, until)
    second = at.copy()
    live = np.flatnonzero(ok)
    gap = colon[live] + 10
    arrow = spans.past(data, gap, until[live], spans.BLANK)
    fine = (arrow > gap) & (arrow + 3 <= until[live])
    fine &= spans.begins_with(data, arrow, "-->")
    ok[live[~fine]] = False
    live, arrow = live[fine], arrow[fine]
    second[live] = spans.past(data, arrow + 3, until[live], spans.BLANK)
    fine = (second[live] > arrow + 3) & _stamp(data, second[live], until[live])[0]
    ok[live[~fine]] = False
    return ok, second


def _times(data: np.ndarray, at: np.ndarray, valid: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The parts and the milliseconds of the stamps at valid places."""
    at = np.where(valid, at, 0)
    colon = at + np.where(data[at + 2] == ord(":"), 2, 3)
    h = np.where(colon == at + 2, spans.small(data, at, 2), spans.small(data, at, 3))
    m, s, f = (np.where(valid, spans.small(data, colon + k, n), 0) for k, n in ((1, 2), (4, 2), (7, 3)))
    h = np.where(valid, h, 0)
    total = ((h.astype(np.int64) * 60 + m) * 60 + s) * 1000 + f
    return spans.stamps(h.astype(np.uint64), m, s, f, valid), pa.array(total, mask=~valid)


def _details(error: np.ndarray, index: np.ndarray, last: np.ndarray) -> pa.Array:
    """What an error tells: the last index and the one got, or the index that has no header."""
    stale, headless = error == NON_MONOTONIC, error == EXPECTED_HEADER
    size = np.where(stale, 2, np.where(headless, 1, 0))
    row = np.repeat(np.arange(len(error)), size)
    second = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) == 1
    key = np.where(headless[row], 0, np.where(second, 2, 1))
    value = np.where(stale[row] & ~second, last[row], index[row])
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(size == 0, False))
    return pa.MapArray.from_arrays(offsets, pa.array(["index", "last", "got"]).take(pa.array(key)), pa.array(value.astype(np.uint64)).cast(pa.string()))


def rows(ids: pa.Array, contents: pa.Array, options: SrtOptions) -> pa.RecordBatch:
    """The entries of documents, and the error that ends a document."""
    data, offsets = spans.joined(contents)
    doc, start, text_end, _ = spans.lines(data, offsets)
    text = spans.past_boms(data, start, text_end)
    # Lines of paragraphs, and the paragraph of each.
    solid = np.flatnonzero(text < text_end)
    doc, start, text, text_end = doc[solid], start[solid], text[solid], text_end[solid]
    opens = np.ones(len(solid), bool)
    opens[1:] = (solid[1:] != solid[:-1] + 1) | (doc[1:] != doc[:-1])
    top = np.flatnonzero(opens)
    para, end = np.cumsum(opens) - 1, np.append(top[1:], len(solid))
    # What each line may be; those that begin with no digit are nothing that is known.
    kind, problem, value, second = np.full(len(solid), BAD, np.int8), np.zeros(len(solid), np.int8), np.zeros(len(solid), np.uint64), text.copy()
    digit = np.flatnonzero(spans.DIGIT[data[text]])
    header, second[digit] = _header(data, text[digit], text_end[digit])
    kind[digit[header]] = HEADER
    digit = digit[~header]
    stop = spans.past(data, text[digit], text_end[digit], spans.DIGIT)
    value[digit], beyond = spans.number(data, text[digit], stop)
    problem[digit] = np.select([stop - text[digit] > 20, beyond, value[digit] == 0], [1, 3, 2], 0)
    kind[digit] = np.where(problem[digit] == 0, NUMBER, BAD)
    # Each paragraph's first line that may begin an entry, and the line after it.
    begins = np.flatnonzero((kind == NUMBER) | ((kind == HEADER) & options.allow_missing_index))
    first = spans.first_of(para, begins, len(top))
    found, at = first >= 0, np.maximum(first, 0)
    has_after = found & (first + 1 < end)
    after = np.where(has_after, at + 1, 0)
    numbered = found & (kind[at] == NUMBER) if len(kind) else found
    orphaned = (first != top) & (not options.ignore_orphan_text)
    headed = has_after & (kind[after] == HEADER) if len(kind) else found
    complete = found & ~orphaned & (~numbered | headed)
    index = np.where(numbered, value[at], 0).astype(np.uint64) if len(kind) else np.zeros(0, np.uint64)
    owner = doc[top]
    last = spans.highest_before(owner, np.where(complete & numbered, index, np.uint64(0)))
    stale = numbered & ~orphaned & (index <= last) & options.monotonic_index
    headless = numbered & ~orphaned & ~complete & (not options.ignore_broken_header) & ~stale
    error = np.full(len(top), -1, np.int8)
    error[orphaned] = np.where(kind[top] == BAD, problem[top], 0)[orphaned]
    if not options.tolerant:
        error[stale] = NON_MONOTONIC
    if len(kind):
        error[headless] = np.where(has_after & (kind[after] == BAD), problem[after], EXPECTED_HEADER)[headless]
    # An error ends its document.
    stops = np.full(len(offsets), len(top))
    wrong = np.flatnonzero(error >= 0)
    lead = spans.firsts(owner[wrong])
    stops[owner[wrong[lead]]] = wrong[lead]
    kept = np.flatnonzero((np.arange(len(top)) <= stops[owner]) & ((complete & ~stale) | (error >= 0)))
    first, owner, error, index, last, numbered = at[kept], owner[kept], error[kept], index[kept], last[kept], numbered[kept]
    ok = error < 0
    head, final = first + numbered, end[kept] - 1
    body, has_body = head + 1, ok & (head < final)
    body_end = text_end[final] if len(kept) else first
    body_start = np.where(has_body, start[np.minimum(body, len(start) - 1)], body_end) if len(kept) else first
    head = np.where(ok, head, 0)
    stamp = [_times(data, place[head] if len(kept) else first, ok) for place in (text, second)]
    begin = spans.firsts(owner)
    ordinal = np.arange(len(kept)) - np.repeat(begin, np.diff(np.append(begin, len(kept))))
    columns = [
        ids.take(pa.array(owner)), pa.array(ordinal, pa.int32()), spans.decimals(index, ok & numbered), stamp[0][0], stamp[1][0], stamp[0][1], stamp[1][1], spans.texts(data, body_start, body_end, ok),
        ERRORS.take(pa.array(error, pa.int32(), mask=ok)), _details(error, index, last),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "ordinal", "index", "start", "end", "start_ms", "end_ms", "body", "error", "error_detail"])


def reader(options: SrtOptions, most: int = spans.SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "content", most):
                yield rows(part.column("doc_id"), part.column("content"), options)

    return read


def parse_srt(docs: DataFrame, options: SrtOptions = SrtOptions(), most: int = spans.SLICE) -> DataFrame:  # noqa: B008
    """The rows of ``srt.parse_srt`` for ``docs(doc_id, content)``, equal in
    columns, types and values, for every option.

    Null and empty contents have no rows; rows of one ``doc_id``, of any type,
    are read apart; other columns are left out; an empty table gives an empty
    one.  Bytes that are not UTF-8 stay as they are.  ``most`` bytes of
    documents, or one document, are looked at together.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(SCHEMA).fields]
    return docs.select("doc_id", "content").mapInArrow(reader(options, most), T.StructType(fields))
