"""SentencePiece encoding and decoding by vectorised merge rounds.

A text's spaces become a visible mark, one more mark is put in front, and the
text is cut into words before each run of marks: no piece of the vocabulary
crosses such a cut.  The words that are not remembered lie end to end in flat
arrays of symbols, one code point each.  A round finds the least rank of each
word's pairs by a segmented minimum, merges the leftmost pairs of that rank in
all words at once, and compacts the arrays; words without a pair left drop
out, and rounds go on until none remains.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cueframe.llm.common import unused

#: What stands for a space in pieces, and what ids without a piece decode to (fixed values).
MARK = "▁"
#: Types of pieces in a model file (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2
_TOP = 0x110000
_NONE = np.int32(1 << 30)
#: Characters of new words merged at once, and the longest word that rounds take; longer ones go by a heap.
BATCH_CHARS = 1 << 18
LONGEST = 256
#: Words whose ids a worker remembers, the longest of them, and rows whose results it holds at once.
CACHE = 1 << 17
CACHED_CHARS = 64
ROWS = 256


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """Bytes that are no UTF-8 decode to one replacement character each."""
    return "�", error.start + 1


codecs.register_error("cueframe-each-byte", _each_byte)


class Model:
    """Pieces, ranks and pairs of a BPE model file, with the ids of words seen lately."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        text = proto.normalizer_spec
        if proto.trainer_spec.model_type != _BPE or text.precompiled_charsmap or text.remove_extra_whitespaces or not text.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that keep texts as they are, with marks before words")
        kinds = [p.type for p in proto.pieces]
        if _USER in kinds or _UNUSED in kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.front = MARK if text.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.control = {i for i, kind in enumerate(kinds) if kind == _CONTROL}
        (self.unknown,) = (i for i, kind in enumerate(kinds) if kind == _UNKNOWN)
        self.bytes = np.full(256, self.unknown, dtype=np.int32)
        for i, kind in enumerate(kinds):
            if kind == _BYTE:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.fallback = proto.trainer_spec.byte_fallback
        self._tokens(kinds, proto.trainer_spec.unk_surface)
        self._pairs({self.pieces[i]: i for i, kind in enumerate(kinds) if kind == _NORMAL}, np.array([p.score for p in proto.pieces]))
        self.cache: dict[str, bytes] = {}

    def _tokens(self, kinds: list[int], unknown: str) -> None:
        self.tokens = []
        for piece, kind in zip(self.pieces, kinds, strict=True):
            whole = {_CONTROL: "", _UNKNOWN: unknown}.get(kind, piece.replace(MARK, " "))
            self.tokens.append(bytes([int(piece[3:5], 16)]) if kind == _BYTE else whole.encode())
        self.marked = {i for i, kind in enumerate(kinds) if kind == _NORMAL and self.pieces[i].startswith(MARK)}

    def _pairs(self, ids: dict[str, int], scores: np.ndarray) -> None:
        """The pairs of symbols that make a piece, and a rank per piece: equal
        scores share a rank."""
        if any(MARK in piece.lstrip(MARK) for piece in ids):
            raise ValueError("a piece holds a mark within, so texts cannot be cut at words")
        # Characters that are in pieces but no piece themselves: symbols beyond the ids.
        lone = sorted({c for piece in ids for c in piece} - ids.keys())
        symbols = ids | {c: len(self.pieces) + k for k, c in enumerate(lone)}
        self.chars = np.full(_TOP, -1, dtype=np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        keys, made = [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int32)[order]
        self.lookup = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = np.append(rank.astype(np.int32), _NONE)  # at -1: no piece
        # A piece that a neighbour may join at no greater rank: its next occurrence has to wait for that.
        self.alone = np.zeros(len(self.pieces) + len(lone) + 1, dtype=bool)
        joins = self.rank[self.made]
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            is_piece = part < len(self.pieces)
            self.alone[part[is_piece]] |= joins[is_piece] <= self.rank[part[is_piece]]
        self.newline = self.chars[ord("\n")] < 0

    def product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.made[at], np.int32(-1))

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, by merge rounds."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
        n = len(points)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.full(n, -1, dtype=np.int32)
        # Each symbol: what it is, its word, and where it starts; then the piece that it makes with the next.
        symbol, at = self.chars[points], np.arange(n)
        out = np.where(symbol < len(self.pieces), symbol, -1)
        known = np.ones(n, dtype=bool)  # starts a symbol of the result
        long = np.flatnonzero(sizes > LONGEST)
        made = np.full(n, -1, dtype=np.int32)
        if n > 1:
            made[:-1] = np.where(word[:-1] == word[1:], self.product(symbol[:-1], symbol[1:]), first[:-1])
        for k in long.tolist():
            self._merge_long(symbol[ends[k] - sizes[k] : ends[k]], out[ends[k] - sizes[k] : ends[k]], known[ends[k] - sizes[k] : ends[k]])
        live = ~np.isin(word, long)
        symbol, at, made, word = symbol[live], at[live], made[live], word[live]
        while len(symbol):
            rank = self.rank[made]
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.append(heads, len(symbol)))
            lowest = np.repeat(least, lengths)
            stays = lowest < _NONE
            if not stays.all():
                symbol, at, made, word, rank, lowest = symbol[stays], at[stays], made[stays], word[stays], rank[stays], lowest[stays]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == lowest)
            # Of pairs that overlap, every other one from the left; of pieces that stand alone, the leftmost of the word.
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            order = np.arange(len(hit))
            odd = (order - np.maximum.accumulate(np.where(run, order, 0))) & 1
            leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])
            lone = np.maximum.accumulate(np.where(leftmost, order, 0))
            hit = hit[(odd == 0) & (leftmost | ~self.alone[made[hit]] & ~self.alone[made[hit[lone]]])]
            symbol[hit] = made[hit]
            out[at[hit]] = made[hit]
            known[at[hit + 1]] = False
            gone = np.zeros(len(symbol), dtype=bool)
            gone[hit + 1] = True
            fresh = np.zeros(len(symbol), dtype=bool)
            fresh[hit] = True
            left = ~gone
            symbol, at, made, word, fresh = symbol[left], at[left], made[left], word[left], fresh[left]
            # Pairs with a new symbol on either side.
            fresh[:-1] |= fresh[1:]
            some = np.flatnonzero(fresh)
            after = np.minimum(some + 1, len(symbol) - 1)
            joins = (some + 1 < len(symbol)) & (word[some] == word[after])
            made[some] = np.where(joins, self.product(symbol[some], symbol[after]), np.int32(-1))
        return self._packed(points, out, known, ends)

    def _packed(self, points: np.ndarray, out: np.ndarray, known: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids word by word; characters that no piece covers are bytes, or
        unknown, a run of them once, where the model has no bytes."""
        upto = np.append(0, np.cumsum(known))
        places = np.flatnonzero(known)
        ids = out[places]
        lack = np.flatnonzero(ids < 0)
        if len(lack):
            if self.fallback:
                raw = [self.bytes[list(chr(c).encode())] for c in points[places[lack]].tolist()]
                many = np.ones(len(ids), dtype=np.int64)
                many[lack] = list(map(len, raw))
                starts = np.cumsum(many) - many
                wide = np.repeat(ids, many)
                for start, new in zip(starts[lack].tolist(), raw, strict=True):
                    wide[start : start + len(new)] = new
                upto = np.append(starts, len(wide))[upto]
                ids = wide
            else:
                ids = np.where(ids < 0, np.int32(self.unknown), ids)
        packed = ids.astype("<i4").tobytes()
        stops = (upto[ends] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _merge_long(self, symbol: np.ndarray, out: np.ndarray, known: np.ndarray) -> None:
        """The same for one word of any length, by a heap over a linked list."""
        now, n = symbol.tolist(), len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank = self.rank.tolist()
        heap: list[tuple[int, int, int, int]] = []

        def look(i: int, j: int) -> None:
            made = self.lookup.get(now[i] << 32 | now[j]) if now[i] >= 0 and now[j] >= 0 else None
            if made is not None:
                heapq.heappush(heap, (rank[made], i, now[i], now[j]))

        for i in range(n - 1):
            look(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or now[i] != a or now[j] != b:
                continue
            now[i], alive[j], after[i] = self.lookup[a << 32 | b], False, after[j]
            out[i] = now[i]
            if after[i] < n:
                before[after[i]] = i
                look(i, after[i])
            if before[i] >= 0:
                look(before[i], i)
        known[:] = alive

    def words(self, text: str) -> list[str]:
        """The words of a text, line ends by themselves where no piece holds one."""
        found: list[str] = []
        marked = self.front + text.replace(" ", MARK)
        for k, line in enumerate(marked.split("\n") if self.newline else [marked]):
            if k:
                found.append("\n")
            head, *rest = line.split(MARK)
            if head:
                found.append(head)
            run = MARK
            for part in rest:
                if part:
                    found.append(run + part)
                    run = MARK
                else:
                    run += MARK
            if len(run) > 1:
                found.append(run[1:])
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.words(text) if text else [] for text in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        ids = self.cache
        new = list({word for words in split for word in words} - ids.keys())
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (stop == at or size + len(new[stop]) <= BATCH_CHARS):
                size += len(new[stop])
                stop += 1
            ids.update(zip(new[at:stop], self.merge(new[at:stop]), strict=True))
            at = stop
        found = [b"".join(map(ids.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > CACHED_CHARS:
                del ids[word]
        if not self.fallback:
            found = [self._runs(packed) for packed in found]
        return found

    def _runs(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<i4")
        lacks = ids == self.unknown
        return ids[~(lacks & np.append(False, lacks[:-1]))].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids beyond the vocabulary raise an error."""
        if not self.control.isdisjoint(ids):
            # They stand for nothing, but bytes on their two sides are no one character.
            shown: list[list[int]] = [[]]
            for i in ids:
                shown.append([]) if i in self.control else shown[-1].append(i)
        else:
            shown = [ids]
        raw = "".join(b"".join(map(self.tokens.__getitem__, part)).decode("utf-8", "cueframe-each-byte") for part in shown)
        first = next((part[0] for part in shown if part), -1)
        return raw[1:] if self.front and first in self.marked else raw


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, the ids of each whole text as an array of
    integers, as the sentencepiece library gives them without begin or end ids
    and without sampling; on request also ``decoded_col``, what ``decode``
    makes of them, in the same pass.

    ``path`` is a BPE model file that executors can open.  Null and empty texts
    have no ids and decode to the empty text; equal texts have equal ids, and
    repeated rows stay; of equal pairs the leftmost merges first, as in the
    library; an empty table gives no rows.  Other columns pass through, or
    those in ``keep`` only, and columns already called like one of the new ones
    are replaced.  Memory follows the longest text; a word beyond ``LONGEST``
    characters is merged by a heap, in time about linear in its length.
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    (text,) = unused(docs, "_text")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(path)
        for whole in batches:
            # What is made of a few rows goes out before the next are read.
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                packed = known.encode(b.column(0).to_pylist())
                flat = np.frombuffer(b"".join(packed), dtype="<i4")
                stops = np.cumsum([0, *(len(p) // 4 for p in packed)])
                columns = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded_col:
                    columns.append(pa.array([known.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], [*keep, *new])

    picked = docs.select(F.col(text_col).cast("string").alias(text), *[F.col(f"`{c}`") for c in keep])
    kinds = [ArrayType(IntegerType(), False), StringType()]
    return picked.mapInArrow(run, StructType([*(StructField(c, docs.schema[c].dataType) for c in keep), *(StructField(c, kind) for c, kind in zip(new, kinds, strict=False))]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the text that an array of ids stands for, as
    the library's ``decode`` gives it (null: null; no ids: the empty text).
    Bytes that are no UTF-8 come out as one U+FFFD each."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        known = model(path)
        return pd.Series([None if x is None else known.decode([int(i) for i in x]) for x in ids], dtype=object)

    return docs.withColumn(out_col, run(F.col(ids_col)))


def joined(ids_col: str = "ids") -> Column:
    """The ids as decimal numbers with commas between."""
    return F.array_join(F.col(ids_col).cast("array<string>"), ",")
