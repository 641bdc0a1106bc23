"""WebVTT documents as rows, an Arrow batch at a time.

The rows of ``vtt.parse_vtt``, made in another way: lines, paragraphs, openers,
arrows and timings of a batch are found together in numpy arrays, and
identifiers, settings and bodies are slices of the documents' bytes.  Settings
are read once for each text of them that a slice of a batch holds; regions, of
which there are few, by the expressions of ``vtt``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueframe.functions import spans
from cueframe.operators import vtt

STAMP = "struct<h:decimal(20,0),m:int,s:int,f:int>"
SETTINGS = "struct<vertical:string,line:struct<pct:double,num:int,align:string>,position:struct<pct:double,align:string>,size:double,align:string,region:string>"
SCHEMA = f"ordinal int, block_type string, identifier string, start {STAMP}, end {STAMP}, start_ms decimal(30,0), end_ms decimal(30,0), settings {SETTINGS}, body string, error string"
OPENERS = ("NOTE", "STYLE", "REGION")
CUE = len(OPENERS) + 1
TYPES = pa.array(["none", *(w.lower() for w in OPENERS), "cue"])
ERRORS = pa.array(["MissingSignature", "InvalidSignature"])
_LINE = pa.struct([("pct", pa.float64()), ("num", pa.int32()), ("align", pa.string())])
_POSITION = pa.struct([("pct", pa.float64()), ("align", pa.string())])
SETTINGS_TYPE = pa.struct([("vertical", pa.string()), ("line", _LINE), ("position", _POSITION), ("size", pa.float64()), ("align", pa.string()), ("region", pa.string())])
_PERCENT, _WHOLE = re.compile(rf"({vtt._FLOAT})%"), re.compile(r"[+-]?0*[0-9]{1,18}")


def _percentage(text: str) -> float | None:
    found = _PERCENT.fullmatch(text)
    value = float(found[1]) if found else -1.0
    return value if 0 <= value <= 100 else None


def cue_settings(text: str) -> dict | None:
    """The settings after a timing, the last valid one of each key; None where none is valid."""
    found: dict = {}
    for token in re.split("[ \t\f]", text):
        key, colon, value = token.partition(":")
        if colon and not value:
            break
        head, comma, tail = value.partition(",")
        if key == "vertical" and value in vtt.VERTICAL or key == "align" and value in vtt.ALIGN or key == "region" and colon:
            found[key] = value
        elif key == "size":
            size = _percentage(value)
            found |= {} if size is None else {"size": size}
        elif key == "line" and (not comma or tail in vtt.LINE_ALIGN):
            pct, num = _percentage(head), int(head) if _WHOLE.fullmatch(head) else None
            if pct is not None or num is not None and -(2**31) <= num < 2**31:
                found[key] = {"pct": pct, "num": num, "align": tail if comma else None}
        elif key == "position" and (not comma or tail in vtt.POSITION_ALIGN):
            pct = _percentage(head)
            if pct is not None:
                found[key] = {"pct": pct, "align": tail if comma else None}
    return found or None


def _settings(texts: pa.Array) -> pa.Array:
    coded = texts.dictionary_encode()
    each = [cue_settings(t.decode("utf-8", "replace")) for t in coded.dictionary.cast(pa.binary()).to_pylist()]
    return pa.array(each, SETTINGS_TYPE).take(coded.indices)


def _stamp(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a timestamp begins at each place, and where its minutes are."""
    colon = spans.past(data, at, until, spans.DIGIT)
    hours = data[colon + 3] == ord(":")
    minutes = np.where(hours, colon + 1, at)
    ok = (colon > at) & (data[colon] == ord(":")) & (hours | (colon == at + 2)) & (minutes + 9 <= until)
    minutes = np.where(ok, minutes, 0)
    for k, want in enumerate("50:50.000"):
        got = data[minutes + k]
        ok &= got == ord(want) if want in ":." else spans.DIGIT[got] & ((want == "0") | (got <= ord("5")))
    return ok, minutes


def _hours(data: np.ndarray, at: np.ndarray, minutes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hours of stamps, and whether they are beyond 64 bits; any number of leading zeros."""
    end = np.maximum(minutes - 1, at)
    begin = spans.past(data, at, end, spans.members("0"))
    value, beyond = spans.number(data, begin, end)
    return value, beyond | (end - begin > 20)


def _timing(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether a timing begins at each place (white space before it left out);
    where its stamps are, their minutes, their hours, and where it ends."""
    first = spans.past(data, at, until, spans.BLANK)
    ok, minutes = _stamp(data, first, until)
    gap = np.where(ok, minutes + 9, first)
    arrow = spans.past(data, gap, until, spans.BLANK)
    ok &= (arrow > gap) & (arrow + 3 <= until) & spans.begins_with(data, arrow, "-->")
    after = np.where(ok, arrow + 3, first)
    second = spans.past(data, after, until, spans.BLANK)
    fine, late = _stamp(data, second, until)
    ok &= (second > after) & fine
    minutes, late = np.where(ok, minutes, first), np.where(ok, late, second)
    (h, beyond), (g, further) = _hours(data, first, minutes), _hours(data, second, late)
    return ok & ~beyond & ~further, minutes, late, h, g, late + 9


def _times(data: np.ndarray, hours: np.ndarray, minutes: np.ndarray, valid: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The parts of stamps and their milliseconds, which 64 bits may not hold."""
    minutes, hours = np.where(valid, minutes, 0), np.where(valid, hours, np.uint64(0))
    m, s, f = (np.where(valid, spans.small(data, minutes + k, n), 0) for k, n in ((0, 2), (3, 2), (6, 3)))
    rest = ((m * 60 + s) * 1000 + f).astype(np.uint64)
    low, high = hours * np.uint64(3600000) + rest, np.zeros(len(hours), np.uint64)
    for k in np.flatnonzero(hours >= np.uint64(1 << 42)):
        whole = int(hours[k]) * 3600000 + int(rest[k])
        low[k], high[k] = whole & (1 << 64) - 1, whole >> 64
    return spans.stamps(hours, m, s, f, valid), spans.decimals(low, valid, high, 30)


def rows(ids: pa.Array, contents: pa.Array) -> pa.RecordBatch:
    """The blocks of documents, or the error of one without a signature."""
    data, offsets = spans.joined(contents)
    doc, start, text_end, _ = spans.lines(data, offsets, lone_cr=True)
    text = spans.past_boms(data, start, text_end)
    # Signatures: the first line of each document, if it has one.
    fault = np.zeros(len(offsets) - 1, np.int8)
    lead = spans.firsts(doc)
    signed = (text[lead] + 6 <= text_end[lead]) & spans.begins_with(data, text[lead], "WEBVTT")
    after = text[lead] + 6
    closed = signed & ((after == text_end[lead]) | (data[after] == ord(" ")) | (data[after] == ord("\t")))
    fault[doc[lead[closed]]] = -1
    fault[doc[lead[signed & ~closed]]] = 1
    # Lines of paragraphs; the first paragraph is the header, whose first line is left out.
    top = np.zeros(len(doc), bool)
    top[lead] = True
    solid = np.flatnonzero((start < text_end) & (fault[doc] < 0))
    opens = np.ones(len(solid), bool)
    opens[1:] = (solid[1:] != solid[:-1] + 1) | (doc[solid[1:]] != doc[solid[:-1]])
    para = np.cumsum(opens) - 1
    header = top[solid[opens]][para] if len(solid) else opens
    rest = ~top[solid]
    solid, header = solid[rest], header[rest]
    para = np.unique(para[rest], return_inverse=True)[1]
    doc, start, text, text_end = doc[solid], start[solid], text[solid], text_end[solid]
    count, line = (int(para[-1]) + 1 if len(para) else 0), np.arange(len(solid))
    begin = spans.firsts(para)
    place = line - begin[para] if count else line
    end = np.append(begin[1:], len(solid)) if count else begin
    owner = doc[begin]
    # Arrows and timings.
    tip = np.flatnonzero(data[: offsets[-1]] == ord(">"))
    tip = tip[(tip >= 2) & (data[tip - 1] == ord("-")) & (data[tip - 2] == ord("-"))]
    at = np.searchsorted(start, tip, "right") - 1
    at = np.unique(at[(at >= 0) & (start[at] <= tip - 2) & (tip < text_end[at])]) if len(solid) else line
    arrow, timed = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
    arrow[at] = True
    good, *timing = _timing(data, text[at], text_end[at])
    timed[at] = good
    where = np.zeros(len(solid), np.int64)
    where[at] = np.arange(len(at))
    # What a line may open, if it is looked at as the start of a block.
    lead = spans.first_of(para, at, count)
    later = (lead[para] >= 0) & (line > lead[para]) if count else arrow
    bare = np.zeros(len(solid), bool)
    bare[1:] = text[:-1] >= text_end[:-1]
    fresh = np.where(arrow, later | header | (place == 0) | bare, ~later & ~header)
    kind = np.zeros(len(solid), np.int8)
    for k, word in enumerate(OPENERS, 1):
        may = np.flatnonzero(fresh & (data[text] == ord(word[0])) & (text + len(word) <= text_end))
        stop = text[may] + len(word)
        fine = spans.begins_with(data, text[may], word) & ((stop == text_end[may]) | (data[stop] == ord(" ")) | (data[stop] == ord("\t")))
        kind[may[fine]] = k
    # The first cue of a document bars styles and regions from then on.
    opener, cue = spans.first_of(para, np.flatnonzero(kind), count), spans.first_of(para, np.flatnonzero(timed), count)
    cue = np.where((cue >= 0) & ((opener < 0) | (cue < opener)), cue, -1)
    sealed = spans.first_of(owner, np.flatnonzero(cue >= 0), len(offsets))[owner]
    barred = (sealed >= 0) & (sealed < np.arange(count))
    cue = np.where(sealed == np.arange(count), cue, -1)
    if count:
        allowed = (kind == 1) | ((kind > 0) & ~barred[para] & ((cue[para] < 0) | (line < cue[para])))
        opener = spans.first_of(para, np.flatnonzero(allowed), count)[para]
        starts = np.flatnonzero(((opener < 0) | (line <= opener)) & (arrow | (line == opener)))
    else:
        opener = starts = line
    until = np.append(starts[1:], len(solid))
    until = np.minimum(until, end[para[starts]]) if count else until
    opened = starts == opener[starts]
    sort = np.where(opened, kind[starts], np.where(timed[starts], CUE, 0))
    kept = sort > 0
    starts, until, sort = starts[kept], until[kept], sort[kept]
    # Spans of what the blocks hold.
    inline = spans.past_white(data, np.minimum(text[starts] + 5, text_end[starts]), text_end[starts])
    told = (sort == 1) & (inline < text_end[starts])
    final = text_end[until - 1]
    body = np.where(told, inline, np.where(starts + 1 < until, start[np.minimum(starts + 1, max(len(solid) - 1, 0))], final)) if len(starts) else final
    is_cue = sort == CUE
    named = is_cue & arrow[starts] & ~fresh[starts]
    before = np.maximum(starts - 1, 0)
    first, second, h, g, rest = (t[where[starts]] if len(starts) else t[:0] for t in timing)
    faults = np.flatnonzero(fault >= 0)
    none, n = np.zeros(len(faults), np.int64), len(starts)
    more = lambda x: np.concatenate([x, none.astype(x.dtype)])
    real = more(np.ones(n, bool))
    is_cue, named = more(is_cue), more(named)
    out = np.concatenate([doc[starts], faults])
    lead = spans.firsts(doc[starts])
    ordinal = more(np.arange(n) - np.repeat(lead, np.diff(np.append(lead, n))))
    stamp = [_times(data, more(a), more(b), is_cue) for a, b in ((h, first), (g, second))]
    columns = [
        ids.take(pa.array(out)), pa.array(ordinal, pa.int32()), TYPES.take(pa.array(more(sort), pa.int32(), mask=~real)), spans.texts(data, more(text[before]), more(text_end[before]), named),
        stamp[0][0], stamp[1][0], stamp[0][1], stamp[1][1], _settings(spans.texts(data, more(rest), more(text_end[starts]), is_cue)), spans.texts(data, more(body), more(final), real),
        ERRORS.take(pa.array(np.concatenate([np.zeros(n, np.int32), fault[faults]]), pa.int32(), mask=real)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "ordinal", "block_type", "identifier", "start", "end", "start_ms", "end_ms", "settings", "body", "error"])


def reader(most: int = spans.SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "content", most):
                yield rows(part.column("doc_id"), part.column("content"))

    return read


def parse_vtt(docs: DataFrame, most: int = spans.SLICE) -> DataFrame:
    """The rows of ``vtt.parse_vtt`` for ``docs(doc_id, content)``, equal in
    columns, types and values.

    Null contents have no rows; an empty one lacks its signature; rows of one
    ``doc_id``, of any type, are read apart; other columns are left out; an
    empty table gives an empty one.  ``most`` bytes of documents, or one
    document, are looked at together.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(SCHEMA).fields]
    found = docs.where(F.col("content").isNotNull()).select("doc_id", "content").mapInArrow(reader(most), T.StructType(fields))
    region = F.col("block_type") == "region"
    made = {"region": F.when(region, vtt.region_settings(F.col("body"))).cast(T._parse_datatype_string(vtt.BLOCK)["region"].dataType), "body": F.when(~region, F.col("body"))}
    return found.select("doc_id", "ordinal", *[made.get(c, F.col(c)).alias(c) for c in vtt.FIELDS])
