"""Timestamps: text to milliseconds (ASS: centiseconds), to parts, and back.

A timestamp is a struct ``(h, m, s, f)`` whose ``f`` holds milliseconds or
centiseconds; hours are ``decimal(20, 0)``, as two formats bound them only by
64 bits.  Text out of grammar or range gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueframe.functions.arrays import let

#: The most that 64 bits hold, as text: literals of the session are signed.
U64 = "18446744073709551615"
SRT = r"([0-9]{2,3}:[0-5][0-9]:[0-5][0-9],[0-9]{3})"
VTT = r"((?:[0-9]+:)?[0-5][0-9]:[0-5][0-9]\.[0-9]{3})"
ASS = r"([0-9]+:[0-5][0-9]:[0-5][0-9]\.[0-9]{2})"


def _u64(digits: Column) -> Column:
    """Digits as a number, null beyond 64 bits; any number of leading zeros."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    value = F.when(F.length(short) <= 20, short.try_cast("decimal(38,0)"))
    large = F.when(value <= F.lit(U64).cast("decimal(38,0)"), value).cast("decimal(20,0)")
    return F.when(F.length(digits) <= 18, digits.try_cast("long").cast("decimal(20,0)")).otherwise(large)


def _parts(text: Column, pattern: str, places: int) -> Column:
    """The struct of a stamp of this pattern, whose last field has ``places``
    digits; fields of fixed width are read from the right."""
    at = lambda k: F.substring(text, -(places + 3 * k), 2).try_cast("int")
    rest = places + 7
    hours = F.when(F.length(text) <= rest, F.lit(0).cast("decimal(20,0)")).otherwise(_u64(F.left(text, F.length(text) - rest)))
    found = F.struct(hours.alias("h"), at(2).alias("m"), at(1).alias("s"), F.right(text, F.lit(places)).try_cast("int").alias("f"))
    return F.when(text.rlike(f"^{pattern}\\z") & hours.isNotNull(), found)


def srt(text: Column) -> Column:
    return _parts(text, SRT, 3)


def vtt(text: Column) -> Column:
    return _parts(text, VTT, 3)


def ass(text: Column) -> Column:
    return _parts(text, ASS, 2)


def total(ts: Column, unit: int = 1000) -> Column:
    """All of a timestamp in milliseconds (``unit`` 1000) or centiseconds (100)."""

    def added(t: Column) -> Column:
        seconds = t["h"].cast("decimal(26,0)") * 3600 + (t["m"] * 60 + t["s"]).cast("decimal(26,0)")
        large = (seconds * unit + t["f"].cast("decimal(26,0)")).cast("decimal(30,0)")
        small = (t["h"].cast("long") * 3600 + t["m"] * 60 + t["s"]) * unit + t["f"]
        return F.when(t["h"] < 10**9, small.cast("decimal(30,0)")).otherwise(large)

    return let(ts, added)


def from_total(n: Column, unit: int = 1000, most_hours: int | None = None) -> Column:
    """The inverse of ``total``; null for negative values or beyond ``most_hours``."""

    def parts(hours: Column, rest: Column) -> Column:
        fields = F.struct(
            hours.cast("decimal(20,0)").alias("h"), F.floor(rest / (60 * unit)).cast("int").alias("m"), (F.floor(rest / unit) % 60).cast("int").alias("s"), (rest % unit).cast("int").alias("f")
        )
        return F.when(F.lit(True) if most_hours is None else hours <= most_hours, fields)

    def small(v: Column) -> Column:
        return let(v % (3600 * unit), lambda rest: parts(((v - rest) / (3600 * unit)).cast("long"), rest))

    def large(v: Column) -> Column:
        return let(F.floor(v / (3600 * unit)).cast("decimal(30,0)"), lambda hours: parts(hours, (v - hours * (3600 * unit)).cast("long")))

    return F.when(n.cast("double").between(0.0, 1e15), let(n.try_cast("long"), small)).when(n > 0, let(n.cast("decimal(30,0)"), large))


def _of_total(n: Column, unit: int, encode: Callable[[Column], Column], hours: Callable[[Column], Column], point: str, places: int) -> Column:
    """``encode(from_total(n))`` by plain arithmetic where ``n`` is small."""
    v = n.try_cast("long")
    part = lambda size, most: F.pmod((v - F.pmod(v, F.lit(size))) / size, F.lit(most)).cast("long")
    h = ((v - F.pmod(v, F.lit(3600 * unit))) / (3600 * unit)).cast("long")
    tail = [_two(part(60 * unit, 60)), F.lit(":"), _two(part(unit, 60)), F.lit(point), F.lpad(F.pmod(v, F.lit(unit)).cast("string"), places, "0")]
    return F.when(n.cast("double").between(0.0, 1e15), F.concat(hours(h), *tail)).otherwise(encode(from_total(n, unit)))


def srt_of(ms: Column) -> Column:
    """A SubRip stamp of milliseconds."""
    return _of_total(ms, 1000, encode_srt, lambda h: F.concat(show_hour(h), F.lit(":")), ",", 3)


def vtt_of(ms: Column) -> Column:
    """A WebVTT stamp of milliseconds."""
    return _of_total(ms, 1000, encode_vtt, lambda h: F.when(h == 0, "").otherwise(F.concat(show_hour(h), F.lit(":"))), ".", 3)


def ass_of(cs: Column) -> Column:
    """An ASS stamp of centiseconds."""
    return _of_total(cs, 100, encode_ass, lambda h: F.concat(h.cast("string"), F.lit(":")), ".", 2)


def _to_total(text: Column, pattern: str, places: int, unit: int) -> Column:
    """``total`` of a stamp by plain arithmetic where its hours are few."""
    at = lambda k: F.substring(text, -(places + 3 * k), 2).try_cast("long")
    size = F.length(text) - (places + 7)
    hours = F.when(size <= 0, F.lit(0).cast("long")).otherwise(F.left(text, size).try_cast("long"))
    fast = ((hours * 60 + at(2)) * 60 + at(1)) * unit + F.right(text, F.lit(places)).try_cast("long")
    return F.when(~text.rlike(f"^{pattern}\\z"), None).when(size <= 9, fast.cast("decimal(30,0)")).otherwise(total(_parts(text, pattern, places), unit))


def srt_ms(text: Column) -> Column:
    """Milliseconds of a SubRip stamp."""
    return _to_total(text, SRT, 3, 1000)


def vtt_ms(text: Column) -> Column:
    """Milliseconds of a WebVTT stamp."""
    return _to_total(text, VTT, 3, 1000)


def ass_cs(text: Column) -> Column:
    """Centiseconds of an ASS stamp."""
    return _to_total(text, ASS, 2, 100)


def interval(ts: Column, unit: int = 1000) -> Column:
    """A day-time interval of a timestamp."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (total(ts, unit) / unit).cast("decimal(18,6)"))


#: Units of a stamp: digits they are padded to, the least of their values beyond range, and the most that their number type holds (fixed values).
UNITS = {"hour": (2, 1000, 65535), "minute": (2, 60, 255), "second": (2, 60, 255), "millisecond": (3, 1000, 65535), "centisecond": (2, 100, 255)}


def unit(text: Column, kind: str) -> Column:
    """``struct<value, error>`` of one unit's text: NotPadded for too few
    digits, Overflow(n) for a number beyond the unit's range or with other
    digits than it has, ParseInt for what is no number of its type."""
    width, beyond, most = UNITS[kind]
    digits = F.regexp_replace(F.regexp_extract(text, r"^\+?([0-9]+)\z", 1), "^0+(?=[0-9])", "")
    number = F.when((digits != "") & (F.length(digits) <= 6), digits.try_cast("long"))
    fine = text.rlike(rf"^(?:[0-9]{{{width}}}|[1-9][0-9]{{{width}}})\z") & (number < beyond)
    error = F.when(text.rlike(rf"^(?:[0-9]{{1,{width - 1}}})\z"), "NotPadded").when(number.isNull() | (number > most), "ParseInt")
    error = error.when(~fine, F.concat(F.lit("Overflow("), number.cast("string"), F.lit(")")))
    return F.struct(F.when(error.isNull(), number).alias("value"), error.alias("error"))


def long_hour(text: Column) -> Column:
    """``struct<value, error>`` of an hour bounded by 64 bits alone."""
    value = F.when(text.rlike(r"^\+?[0-9]+\z"), _u64(F.regexp_replace(text, r"^\+", "")))
    return F.struct(value.alias("value"), F.when(value.isNull(), "ParseInt").alias("error"))


def show_hour(hours: Column) -> Column:
    return F.when(F.length(hours.cast("string")) < 2, _two(hours)).otherwise(hours.cast("string"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _hours(ts: Column) -> Column:
    return F.when(ts["h"] < 10, _two(ts["h"])).otherwise(ts["h"].cast("string"))


def encode_srt(ts: Column) -> Column:
    return let(ts, lambda t: F.concat(_hours(t), F.lit(":"), _two(t["m"]), F.lit(":"), _two(t["s"]), F.lit(","), F.lpad(t["f"].cast("string"), 3, "0")))


def encode_vtt(ts: Column) -> Column:
    def shown(t: Column) -> Column:
        tail = F.concat(_two(t["m"]), F.lit(":"), _two(t["s"]), F.lit("."), F.lpad(t["f"].cast("string"), 3, "0"))
        return F.when(t["h"] == 0, tail).otherwise(F.concat(_hours(t), F.lit(":"), tail))

    return let(ts, shown)


def encode_ass(ts: Column) -> Column:
    return let(ts, lambda t: F.concat(t["h"].cast("string"), F.lit(":"), _two(t["m"]), F.lit(":"), _two(t["s"]), F.lit("."), _two(t["f"])))


def field_order(ts: Column) -> list[Column]:
    """The order that SRT and WebVTT timestamps derive: hours, milliseconds,
    minutes, seconds.  Sort by ``total`` for time."""
    return [ts["h"], ts["f"], ts["m"], ts["s"]]
