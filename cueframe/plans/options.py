"""Options of the parsers, and their JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueframe.functions.arrays import let


class _Json:
    """Snake-case keys; a missing key takes its default; an unknown one is ignored."""

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("options are a JSON object")
        out = {}
        for f in fields(cls):
            if f.name in found:
                value = found[f.name]
                if type(value) is not type(f.default) or (isinstance(value, int) and not isinstance(value, bool) and value < 0):
                    raise ValueError(f"{f.name}: {value!r}")
                out[f.name] = value
        return cls(**out)


@dataclass(frozen=True)
class SrtOptions(_Json):
    allow_missing_index: bool = False
    ignore_orphan_text: bool = False
    ignore_broken_header: bool = False
    monotonic_index: bool = True

    @classmethod
    def strict(cls) -> SrtOptions:
        return cls()

    @classmethod
    def lossy(cls) -> SrtOptions:
        return cls(True, True, True, False)

    @property
    def tolerant(self) -> bool:
        return self.allow_missing_index or self.ignore_orphan_text or self.ignore_broken_header


@dataclass(frozen=True)
class AssOptions(_Json):
    allow_missing_format: bool = False
    allow_short_event: bool = False
    allow_malformed_fields: bool = False
    ignore_unknown_lines: bool = False

    @classmethod
    def strict(cls) -> AssOptions:
        return cls()

    @classmethod
    def lossy(cls) -> AssOptions:
        return cls(True, True, True, True)


@dataclass(frozen=True)
class CueOptions(_Json):
    max_depth: int = 16


#: The columns an event row may have, in the order of the stored form (fixed values).
EVENT_FIELDS = ("ReadOrder", "Marked", "Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")


@dataclass(frozen=True)
class EventFormat:
    """Where each known column of an event row stands, and how many there are."""

    columns: tuple[str | None, ...] = ()

    @classmethod
    def declared(cls, text: str) -> EventFormat:
        """From the value of a Format line: names ignore case, ``Actor`` is
        ``Name``, an unknown name holds its place, the last of equals counts."""
        if not text.strip():
            return cls()
        known = {f.lower(): f for f in EVENT_FIELDS} | {"actor": "Name"}
        names = [known.get(p.strip().lower()) for p in text.split(",")][:255]
        return cls(tuple(n if n and n not in names[i + 1 :] else None for i, n in enumerate(names)))

    @classmethod
    def ass(cls) -> EventFormat:
        return cls.declared("Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")

    @classmethod
    def ssa(cls) -> EventFormat:
        return cls.declared("Marked, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")

    @classmethod
    def matroska(cls) -> EventFormat:
        return cls.declared("ReadOrder, Layer, Style, Name, MarginL, MarginR, MarginV, Effect, Text")

    def __len__(self) -> int:
        return len(self.columns)

    def index_of(self, field: str) -> int | None:
        return self.columns.index(field) if field in self.columns else None

    def field_at(self, index: int) -> str | None:
        return self.columns[index] if 0 <= index < len(self.columns) else None

    def to_json(self) -> str:
        return json.dumps({"slots": [self.index_of(f) for f in EVENT_FIELDS], "fields": len(self.columns)})

    @classmethod
    def from_json(cls, text: str) -> EventFormat:
        found = json.loads(text)
        slots, n = found["slots"], found["fields"]
        used = [s for s in slots if s is not None]
        if len(slots) != len(EVENT_FIELDS) or not 0 <= n <= 255 or len(set(used)) != len(used) or any(not 0 <= s < n for s in used):
            raise ValueError("a position is out of range or taken twice")
        columns: list[str | None] = [None] * n
        for field, s in zip(EVENT_FIELDS, slots, strict=True):
            if s is not None:
                columns[s] = field
        return cls(tuple(columns))

    def column(self) -> Column:
        """The column names as an array literal."""
        return F.array(*[F.lit(c).cast("string") for c in self.columns]).cast("array<string>")


def event_format(declared: Column) -> Column:
    """``EventFormat.declared`` of a column: an array of names, null where none counts."""
    names = F.transform(F.split(declared, ",", 256), lambda p: F.lower(F.regexp_replace(p, r"^[\s\xA0]+|[\s\xA0]+\z", "")))
    known = F.create_map(*[F.lit(x) for f in EVENT_FIELDS for x in (f.lower(), f)], F.lit("actor"), F.lit("Name"))
    named = F.transform(F.slice(names, 1, 255), lambda n: F.try_element_at(known, n))

    def once(ns: Column) -> Column:
        # Of equal names the last one counts: an earlier one finds itself again in what follows.
        later = lambda n, i: F.array_contains(F.slice(ns, i + 2, 255), n)
        return F.transform(ns, lambda n, i: F.when(n.isNotNull() & ~F.coalesce(later(n, i), F.lit(False)), n))

    return F.when(F.trim(declared) == "", F.array().cast("array<string>")).otherwise(let(named, once))
