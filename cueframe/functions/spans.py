"""Spans of bytes in many documents at once, as numpy arrays.

For readers that take an Arrow batch whole: documents lie end to end, a place
is an index into their bytes, and each step looks at all lines together.  All
marks of the formats are ASCII, which no part of a longer UTF-8 sequence is,
so bytes are read as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Zeros behind the last document, so that a look ahead of a place stays in the array.
PAD = 64
#: Bytes that are looked at together: few enough to stay in a core's cache.
SLICE = 1 << 22
MOST = np.uint64(2**64 - 1)
LF, CR = 10, 13
BOM_BYTES = "﻿".encode()


def members(text: str) -> np.ndarray:
    """Which of the 256 bytes are in ``text``."""
    table = np.zeros(256, bool)
    table[list(text.encode())] = True
    return table


BLANK, DIGIT, WHITE = members(" \t\f"), members("0123456789"), members("\t\n\v\f\r ")


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The padded bytes of texts (null: empty), and where each begins and the last ends."""
    if len(texts) == 0:
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros(int(at[-1] - at[0]) + PAD, np.uint8)
    if data is not None:
        out[: len(out) - PAD] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return out, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def lines(data: np.ndarray, offsets: np.ndarray, lone_cr: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that LF ends (or CR alone, if ``lone_cr``), and what stands behind
    the last one of a document: their document, start, the end of their text
    (without its terminator), and end."""
    docs = np.flatnonzero(np.diff(offsets))
    tails = offsets[docs + 1]
    open_tails = tails[(data[tails - 1] != LF) & ~(lone_cr & (data[tails - 1] == CR))]
    ends = [np.flatnonzero(data[: offsets[-1]] == LF) + 1, open_tails]
    if lone_cr:
        alone = np.flatnonzero(data[: offsets[-1]] == CR) + 1
        if len(alone):
            ends.append(alone[(data[alone] != LF) | np.isin(alone, tails)])
    ends = np.sort(np.concatenate(ends), kind="stable") if any(map(len, ends[1:])) else ends[0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    doc = np.searchsorted(offsets, starts, "right") - 1
    text = ends - (data[ends - 1] == LF)
    text -= ((text < ends) | lone_cr) & (text > starts) & (data[text - 1] == CR)
    return doc, starts, text, ends


def past(data: np.ndarray, at: np.ndarray, until: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Where the run of members that begins at each place ends, at most ``until``."""
    at = at.copy()
    live = np.flatnonzero(at < until)
    for _ in range(8):
        live = live[member[data[at[live]]]]
        at[live] += 1
        live = live[at[live] < until[live]]
        if not len(live):
            return at
    stops = np.append(np.flatnonzero(~member[data]), len(data))
    at[live] = np.minimum(stops[np.searchsorted(stops, at[live])], until[live])
    return at


def past_boms(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Where the byte order marks that begin at each place end."""
    at = at.copy()
    live = np.flatnonzero(at + 3 <= until)
    while len(live):
        here = at[live]
        live = live[(data[here] == BOM_BYTES[0]) & (data[here + 1] == BOM_BYTES[1]) & (data[here + 2] == BOM_BYTES[2])]
        at[live] += 3
        live = live[at[live] + 3 <= until[live]]
    return at


def past_white(data: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Where the white space of any script that begins at each place ends."""
    at = at.copy()
    live = np.flatnonzero(at < until)
    while len(live):
        a, b, c = (data[at[live] + k] for k in range(3))
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        three = general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        width = np.select([WHITE[a], two, three], [1, 2, 3], 0)
        at[live] += width
        live = live[(width > 0) & (at[live] < until[live])]
    return at


def begins_with(data: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    """Whether an ASCII word stands at each place."""
    ok = np.ones(len(at), bool)
    for k, want in enumerate(word.encode()):
        ok &= data[at + k] == want
    return ok


def number(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that the first 20 digits of a span make, and whether it is beyond 64 bits."""
    value, beyond, width = np.zeros(len(at), np.uint64), np.zeros(len(at), bool), end - at
    for k in range(min(int(width.max(initial=0)), 20)):
        live = np.flatnonzero(width > k)
        digit = (data[at[live] + k] - np.uint8(48)).astype(np.uint64)
        beyond[live] |= value[live] > (MOST - digit) // np.uint64(10)
        value[live] = value[live] * np.uint64(10) + digit
    return value, beyond


def small(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The number of so many digits at each place."""
    out = np.zeros(len(at), np.int32)
    for k in range(width):
        out = out * 10 + (data[at + k].astype(np.int32) - 48)
    return out


def highest_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value before each item within its group, 0 for the first;
    groups stand together and ascend."""
    if not len(value):
        return value
    known, rank = np.unique(value, return_inverse=True)
    step = len(known) + 1
    seen = np.maximum.accumulate(group.astype(np.int64) * step + rank + 1) - group.astype(np.int64) * step
    before = np.concatenate([[0], seen[:-1]])
    before[1:][group[1:] != group[:-1]] = 0
    return np.where(before > 0, known[np.maximum(before, 1) - 1], np.uint64(0))


def first_of(group: np.ndarray, places: np.ndarray, groups: int) -> np.ndarray:
    """The first of some places, which ascend, in each group of places that
    stand together; -1 where it has none."""
    out = np.full(groups, -1, np.int64)
    lead = places[firsts(group[places])]
    out[group[lead]] = lead
    return out


def firsts(group: np.ndarray) -> np.ndarray:
    """The places where a new group begins, of groups that stand together."""
    if not len(group):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _valid(valid: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(valid, bitorder="little"))


def texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The texts of spans, which ascend and do not overlap, in one copy."""
    width = np.where(valid, end - start, 0)
    if int(width.sum()) > np.iinfo(np.int32).max:
        raise OverflowError("texts of one batch are beyond 2 GB")
    start = np.where(valid, start, np.concatenate([[0], np.maximum.accumulate(np.where(valid, end, 0))[:-1]]) if len(start) else start)
    gaps = start - np.concatenate([[0], (start + width)[:-1]]) if len(start) else start
    turns = np.stack([gaps, width], axis=1).ravel()
    taken = np.repeat(np.tile([False, True], len(start)), turns)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [_valid(valid), pa.py_buffer(offsets), pa.py_buffer(data[: len(taken)][taken])])


def decimals(value: np.ndarray, valid: np.ndarray | None = None, high: np.ndarray | int = 0, digits: int = 20) -> pa.Array:
    """Unsigned numbers as decimals without places; ``high`` are their bits above 64."""
    raw = np.zeros((len(value), 2), np.uint64)
    raw[:, 0], raw[:, 1] = value, high
    return pa.Array.from_buffers(pa.decimal128(digits, 0), len(value), [None if valid is None else _valid(valid), pa.py_buffer(raw)])


def stamps(h: np.ndarray, m: np.ndarray, s: np.ndarray, f: np.ndarray, valid: np.ndarray) -> pa.Array:
    fields = [decimals(h), pa.array(m, pa.int32()), pa.array(s, pa.int32()), pa.array(f, pa.int32())]
    return pa.StructArray.from_arrays(fields, ["h", "m", "s", "f"], mask=pa.array(~valid))
