"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are arrays of code points.  A class array and one symbol of look-ahead
per code point drive a small automaton; its transition functions are composed
associatively, within blocks and then over blocks, so the state before every
code point, and with it every piece boundary, comes from array operations and
no regex.  The slices between boundaries feed a cached pair merger.  Where each
piece starts, in code points and in tokens, is kept beside the ids: decoding
checks the ids by it, and decodes any span of the text without the rest.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cueframe.llm.common import unused

#: Symbols: what a code point is, with the look-ahead that decides it.
LETTER, NUMBER, OTHER, SPACE, WHITE, SPACE_RUN, WHITE_RUN, QUOTE1, QUOTE2, N_SYMBOLS = range(10)
#: States: the class of the code point just read, or letters that a contraction still takes.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_TAKE1, S_TAKE2, S_START = range(8)
_N = 8
#: Code points beyond Unicode's last, and the white space that patterns know as \s (fixed values).
_TOP = 0x110000
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a contraction (fixed values).
_ONE = "stmd"
_TWO = ("re", "ve", "ll")
#: Characters taken into one scan, and columns of a block.
BATCH_CHARS = 1 << 19
BLOCK = 64
#: Pieces whose ids a worker remembers, and rows whose results it holds at once.
CACHE = 1 << 17
ROWS = 256


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by (symbol, state)."""
    step = np.zeros((2 * N_SYMBOLS, _N), dtype=np.uint8)
    starts = np.zeros((2 * N_SYMBOLS, _N), dtype=bool)
    plain = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, QUOTE1: S_OTHER, QUOTE2: S_OTHER}
    for symbol in range(N_SYMBOLS):
        for state in range(_N):
            if symbol in plain:
                to = plain[symbol]
                # A space just read already began this piece.
                new = state not in (to, S_SPACE)
                if symbol in (QUOTE1, QUOTE2) and state not in (S_OTHER, S_SPACE):
                    to, new = (S_TAKE1 if symbol == QUOTE1 else S_TAKE2), True
                elif state in (S_TAKE1, S_TAKE2):
                    to, new = (S_TAKE1 if state == S_TAKE2 else S_START), False
            elif symbol in (SPACE, WHITE):
                # The last white space before something else starts a piece; only a space lets that join it.
                to, new = (S_SPACE if symbol == SPACE else S_START), True
            else:
                # White space before more white space, or at the end: one run.
                to, new = S_WHITE, state != S_WHITE
            step[symbol, state], starts[symbol, state] = to, new
        # The first code point of a text: as after S_START, whatever came before.
        step[N_SYMBOLS + symbol] = step[symbol, S_START]
        starts[N_SYMBOLS + symbol] = True
    return step, starts


STEP, STARTS = _transitions()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of each code point.  Which are letters
    and numbers depends on the version of Unicode; the library whose ids these
    are to equal is asked once what it takes for either."""
    import tiktoken

    table = np.full(_TOP, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, _TOP))))
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        bytewise = tiktoken.Encoding(f"class {name}", pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(bytewise.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4")] = kind
    table[_WHITE] = WHITE
    return table


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts laid end to end; ``firsts`` holds
    where each text starts."""
    n = len(points)
    kind = classes()[points]
    after = np.full(n, OTHER, dtype=np.uint8)
    after[:-1] = kind[1:]
    # At the end of a text nothing follows: white space counts as a run there.
    ends = np.append(firsts[1:], n) - 1
    after[ends] = WHITE
    white, run = kind == WHITE, after == WHITE
    symbol = kind.copy()
    symbol[white & run] = WHITE_RUN
    symbol[white & ~run & (points == 0x20)] = SPACE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        last = ends[np.searchsorted(ends, quotes)]
        one = np.where(quotes + 1 <= last, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= last, points[np.minimum(quotes + 2, n - 1)], 0)
        symbol[quotes[np.isin(one, [ord(c) for c in _ONE])]] = QUOTE1
        for a, b in _TWO:
            symbol[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE2
    symbol[firsts] += N_SYMBOLS
    return symbol


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start, by an associative scan of transition functions."""
    symbol = symbols(points, firsts)
    n = len(symbol)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, dtype=np.intp)
    padded[:n] = symbol
    # Transposed, so that each step reads one contiguous row.
    by_step = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * _N
    flat = STEP.ravel().astype(np.intp)
    # Each block's function: the composition of its symbols' functions.
    block = np.repeat(np.arange(_N)[:, None], rows, axis=1)
    for t in range(BLOCK):
        block = flat[by_step[t] + block]
    # Inclusive scan over blocks by doubling; composition is associative.
    d = 1
    while d < rows:
        block[:, d:] = np.take_along_axis(block[:, d:], block[:, :-d], axis=0)
        d *= 2
    state = np.full(rows, S_START, dtype=np.intp)
    state[1:] = block[S_START, :-1]
    new = np.empty((BLOCK, rows), dtype=bool)
    begins = STARTS.ravel()
    for t in range(BLOCK):
        at = by_step[t] + state
        new[t] = begins[at]
        state = flat[at]
    return np.flatnonzero(new.T.ravel()[:n])


class Vocabulary:
    """Ranks of a byte-level BPE, with the ids of pieces seen lately."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        # Bytes that begin a code point, by token.
        self.points = np.fromiter((sum(b & 0xC0 != 0x80 for b in t) for t in self.tokens), dtype=np.int64, count=len(self.tokens))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ids = array("q"), array("i")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None:
                    keys.append(left << 32 | right)
                    ids.append(rank)
        order = np.argsort(np.frombuffer(keys, dtype=np.int64), kind="stable")
        self.pair_keys, self.pair_ids = np.frombuffer(keys, dtype=np.int64)[order], np.frombuffer(ids, dtype=np.int32)[order]
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each pair of ids merges to, or ``_TOP``."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ids[at], _TOP)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: the lowest-ranked pair merges first, the
        leftmost of equals; all pieces take their next merge together."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > 64:
                out[k] = np.array(self._merge_long(piece), dtype="<u4").tobytes()
            else:
                by_width.setdefault(8 if len(piece) <= 8 else 16 if len(piece) <= 16 else 64, []).append(k)
        for width, members in by_width.items():
            step = (1 << 18) // width
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._merge_rows([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n, w = len(pieces), width + 1
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), dtype=np.uint8)
        ids = self.byte_ids[raw]
        size = np.fromiter(map(len, pieces), dtype=np.intp, count=n)
        # Cells are numbered through; a row's last cell is spare, its id -1 pairs with nothing.
        column = np.tile(np.arange(w), n)
        ids[column >= np.repeat(size, w)] = -1
        alive = ids >= 0
        near = np.full(n * w, _TOP, dtype=np.int32)
        near[:-1] = np.where(alive[:-1] & alive[1:], self._pair_ranks(ids[:-1], ids[1:]), _TOP)
        after, before = np.arange(1, n * w + 1), np.arange(-1, n * w - 1)
        rows = np.arange(n)
        while len(rows):
            grid = near.reshape(n, w)[rows] if len(rows) < n else near.reshape(n, w)
            best = grid.argmin(axis=1)
            low = grid[np.arange(len(rows)), best]
            live = low < _TOP
            rows, low = rows[live], low[live]
            i = rows * w + best[live]
            j = after[i]
            k = after[j]
            ids[i], alive[j], near[j] = low, False, _TOP
            after[i] = k
            before[np.minimum(k, n * w - 1)] = i
            near[i] = self._pair_ranks(low, ids[np.minimum(k, n * w - 1)])
            first = best[live] == 0
            h = np.where(first, i, before[i])
            near[h] = np.where(first, near[i], self._pair_ranks(ids[h], low))
        packed = ids[alive].astype("<u4").tobytes()
        stops = np.cumsum(alive.reshape(n, w).sum(axis=1)) * 4
        return (packed[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False))

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Packed ids of each text, and for each of its pieces the code point
        and the token it starts at."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= BATCH_CHARS:
                yield from self._encode(group)
                group, size = [], 0
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        starts = np.empty(0, dtype=np.intp)
        if joined:
            points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
            starts = piece_starts(points, np.unique(begins[begins < ends]))
        spans = [*starts.tolist(), len(joined)]
        slices = [joined[a:b] for a, b in zip(spans, spans[1:], strict=False)]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(set(slices) - self.cache.keys())
        self.cache.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new]), strict=True))
        packed = list(map(self.cache.__getitem__, slices))
        for piece in new:
            if len(piece) > 64:
                del self.cache[piece]
        first, last = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        token = np.zeros(len(packed) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4, out=token[1:])
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            yield b"".join(packed[a:b]), np.stack([starts[a:b] - begins[k], token[a:b] - token[a]], axis=1)

    def decode(self, packed: bytes, offsets: np.ndarray | None = None) -> bytes | None:
        """The bytes of packed ids; None if ``offsets`` do not fit them."""
        ids = np.frombuffer(packed, dtype="<u4")
        if offsets is not None and not self._fit(ids, offsets):
            return None
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def _fit(self, ids: np.ndarray, offsets: np.ndarray) -> bool:
        """Does each piece start where the tokens before it end?"""
        if not len(ids) or not len(offsets):
            return len(ids) == len(offsets)
        if ids.max() >= len(self.tokens) or offsets[0].any() or offsets[-1, 1] >= len(ids) or (np.diff(offsets, axis=0) < 1).any():
            return False
        before = np.cumsum(self.points[ids]) - self.points[ids]
        return bool((before[offsets[:, 1]] == offsets[:, 0]).all())

    def decode_span(self, packed: bytes, offsets: np.ndarray, start: int, stop: int) -> str:
        """Code points ``start`` to ``stop`` (left out) of the text, from the tokens of the pieces they lie in."""
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids) or stop <= start:
            return ""
        i = max(int(np.searchsorted(offsets[:, 0], start, "right")) - 1, 0)
        j = int(np.searchsorted(offsets[:, 0], stop, "left"))
        upto = int(offsets[j, 1]) if j < len(offsets) else len(ids)
        text = b"".join(map(self.tokens.__getitem__, ids[int(offsets[i, 1]) : upto].tolist())).decode("utf-8", "replace")
        return text[max(start - int(offsets[i, 0]), 0) : stop - int(offsets[i, 0])]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _offsets(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i4").reshape(-1, 2)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = None, decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: each whole text's ids as packed little-endian
    unsigned 32-bit integers, four bytes a token; on request ``offsets_col``:
    for each piece the code point and the token it starts at, packed as
    little-endian 32-bit integers, eight bytes a piece; and on request
    ``decoded_col``: what ``decode`` makes of both, in the same pass and with
    the same vocabulary in memory.

    ``path`` is a file of base64 tokens and ranks that executors can open.
    Null and empty texts have no ids; equal texts have equal ids; an empty
    table gives no rows; other columns pass through, or those in ``keep`` only,
    and columns already called like one of the new ones are replaced.  Memory
    follows the longest text.
    """

    new = {ids_col: "ids", **({offsets_col: "offsets"} if offsets_col else {}), **({decoded_col: "decoded"} if decoded_col else {})}
    (text,) = unused(docs, "_text")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for whole in batches:
            # What is made of a few rows goes out before the next are read.
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                made: dict[str, list[bytes | None]] = {"ids": [], "offsets": [], "decoded": []}
                for ids, starts in words.encode(b.column(0).to_pylist()):
                    made["ids"].append(ids)
                    if offsets_col or decoded_col:
                        made["offsets"].append(starts.astype("<i4").tobytes())
                    if decoded_col:
                        made["decoded"].append(words.decode(ids, _offsets(made["offsets"][-1])))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(made[field], pa.binary()) for field in new.values())], [*keep, *new])

    picked = docs.select(F.col(text_col).cast("string").alias(text), *[F.col(f"`{c}`") for c in keep])
    return picked.mapInArrow(run, StructType([*(StructField(c, docs.schema[c].dataType) for c in keep), *(StructField(c, BinaryType()) for c in new)]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", offsets_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``: the bytes that packed ids stand for (null:
    null); with ``offsets_col`` null also where the offsets do not fit the ids."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series, offsets: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([None if x is None else words.decode(x, None if at is None else _offsets(at)) for x, at in zip(ids, offsets, strict=True)], dtype=object)

    return docs.withColumn(out_col, run(F.col(ids_col), F.col(offsets_col) if offsets_col else F.lit(None).cast("binary")))


def decode_span(docs: DataFrame, path: str, start: Column, stop: Column, ids_col: str = "ids", offsets_col: str = "offsets", out_col: str = "span") -> DataFrame:
    """``docs`` with ``out_col``: code points ``start`` to ``stop`` (left out)
    of each text, by the tokens of the pieces they lie in alone; what lies
    beyond the text is left out (null: null)."""

    @F.pandas_udf("string")
    def run(ids: pd.Series, offsets: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        words = vocabulary(path)
        rows = zip(ids, offsets, a, b, strict=True)
        return pd.Series([None if x is None or at is None or pd.isna(i) or pd.isna(j) else words.decode_span(x, _offsets(at), max(int(i), 0), int(j)) for x, at, i, j in rows], dtype=object)

    return docs.withColumn(out_col, run(F.col(ids_col), F.col(offsets_col), start.cast("long"), stop.cast("long")))


def n_tokens(ids_col: str = "ids") -> Column:
    return (F.octet_length(ids_col) / 4).cast("long")
