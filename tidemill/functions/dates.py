"""Text to timestamp, with one format guessed from the first value."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DateFormat:
    """A text shape and how to rewrite it to ISO order.

    Casting the rewritten text keeps the wall-clock reading whatever the session
    time zone is, which parsing through a zoned timestamp would not.
    """

    name: str
    pattern: str
    iso: str  # template in regexp_replace notation

    def parse(self, col: Column) -> Column:
        return F.when(col.rlike(self.pattern), F.regexp_replace(col, self.pattern, self.iso).try_cast("timestamp_ntz"))


# Date orders (with the separators each is written with) and the
# optional time of day, in the order in which they are tried.
_DATES = [
    ("ymd", sep, rf"(\d{{4}}){re.escape(sep)}(\d{{1,2}}){re.escape(sep)}(\d{{1,2}})", "$1-$2-$3")
    for sep in ("-", "/", ".")
] + [
    ("ymd", "", r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
] + [
    (order, sep, rf"(\d{{1,2}}){re.escape(sep)}(\d{{1,2}}){re.escape(sep)}(\d{{4}})", iso)
    for order, iso in (("mdy", "$3-$1-$2"), ("dmy", "$3-$2-$1"))
    for sep in ("/", "-", ".")
]
_TIMES = [
    ("", "", ""),
    ("hm", r"(\d{1,2}):(\d{1,2})", " $4:$5"),
    ("hms", r"(\d{1,2}):(\d{1,2}):(\d{1,2})", " $4:$5:$6"),
    ("hmsf", r"(\d{1,2}):(\d{1,2}):(\d{1,2}\.\d{1,6})", " $4:$5:$6"),
]
# How a time in UTC may end, after a date with the year first.
_UTC = r"(?:Z|[+-]00:?00)"


def _formats() -> list[DateFormat]:
    found = []
    for (order, sep, date, iso), (clock, time, time_iso) in product(_DATES, _TIMES):
        for joint in ("",) if not clock else (" ", "T"):
            found.append(DateFormat(f"{order}{sep}{joint}{clock}", f"^{date}{joint}{time}$", iso + time_iso))
            if clock and order == "ymd":
                found.append(DateFormat(f"{order}{sep}{joint}{clock}z", f"^{date}{joint}{time}{_UTC}$", iso + time_iso))
    return found


FORMATS = _formats()


# --- shapes with names of months, short years, halves of the day and offsets ---

# The English months.
_MONTHS = "January February March April May June July August September October November December".split()
# Tokens of a shape and what they match.
_TOKENS = {
    "Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})",
    "b": "(" + "|".join(n[:3] for n in _MONTHS) + ")", "B": "(" + "|".join(_MONTHS) + ")",
    "H": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,2}\.\d{1,6})", "p": r"([AP]M)", "z": r"(Z|[+-]\d{2}:?\d{2})",
}
# Orders of a date, in the order in which they are tried; a missing day or month is the first.
_NAMED = ["b d, Y", "b d Y", "d b Y", "d-b-Y", "d/b/Y", "Y-b-d", "d b y", "d-b-y", "b Y", "b-Y"]
_ORDERS = [
    *(f"Y{s}m{s}d" for s in "-/."), *(f"m{s}d{s}Y" for s in "/-."), *(f"d{s}m{s}Y" for s in "/-."),
    *(f"m{s}d{s}y" for s in "/-."), *(f"d{s}m{s}y" for s in "/-."),
    *_NAMED, *(x.replace("b", "B") for x in _NAMED), "Y-m", "Y/m", "Y",
]
_CLOCKS = ["", "H:M", "H:M:S", "H:M:f"]


def _offset_minutes(text: str) -> int:
    if text in "Zz":
        return 0
    return (-1 if text[0] == "-" else 1) * (60 * int(text[1:3]) + int(text[-2:]))


@dataclass(frozen=True)
class Shape:
    """A sequence of tokens, compiled to expressions; times with an offset are given in the offset ``base`` (minutes)."""

    tokens: str
    base: int = 0

    @property
    def pattern(self) -> str:
        body = re.sub(r"[A-Za-z]|[^A-Za-z]", lambda m: _TOKENS.get(m[0]) or ("T" if m[0] == "T" else re.escape(m[0])), self.tokens)
        return f"^(?i:{body})$"

    def fields(self) -> list[str]:
        return [x for x in self.tokens if x in _TOKENS]

    def fits(self, text: str) -> bool:
        match = re.match(self.pattern, text, re.ASCII)
        if not match:
            return False
        found = dict(zip(self.fields(), match.groups(), strict=True))
        low, high = (1, 12) if "p" in found else (0, 23)
        return 1 <= int(found.get("m", 1)) <= 12 and 1 <= int(found.get("d", 1)) <= 31 and low <= int(found.get("H", low)) <= high

    def parse(self, col: Column) -> Column:
        """A short year says nothing about the order, so each such value is read month-first if that fits."""
        if "y" in self.tokens and "m" in self.tokens:
            swapped = Shape(self.tokens.translate(str.maketrans("md", "dm")), self.base)
            first, second = (self, swapped) if self.tokens[0] == "m" else (swapped, self)
            return F.coalesce(first._parse(col), second._parse(col))
        return self._parse(col)

    def _parse(self, col: Column) -> Column:
        part = {x: F.regexp_extract(col, self.pattern, i + 1) for i, x in enumerate(self.fields())}
        year = part.get("Y")
        if year is None:
            short = part["y"].try_cast("int")
            year = (short + F.when(short < 69, 2000).otherwise(1900)).cast("string")
        month = part.get("m", F.lit("1"))
        if (name := part.get("b", part.get("B"))) is not None:
            starts = "".join(n[:3] for n in _MONTHS).lower()
            month = ((F.instr(F.lit(starts), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int").cast("string")
        hour = part.get("H", F.lit("0"))
        if "p" in part:
            number = hour.try_cast("int")
            hour = F.when(number.between(1, 12), number % 12 + F.when(F.lower(part["p"]) == "pm", 12).otherwise(0)).cast("string")
        second = part.get("S", part.get("f", F.lit("0")))
        text = F.concat(year, F.lit("-"), month, F.lit("-"), part.get("d", F.lit("1")), F.lit(" "), hour, F.lit(":"), part.get("M", F.lit("0")), F.lit(":"), second)
        found = text.try_cast("timestamp_ntz")
        if "z" in part:
            zone = part["z"]
            minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
            signed = F.when(F.upper(zone) == "Z", 0).when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
            zero = F.lit(0)
            found = found - F.make_dt_interval(zero, zero, signed - self.base, zero.cast("decimal(18,6)"))
        return F.when(col.rlike(self.pattern), found)


def _shapes() -> list[Shape]:
    found = []
    for order, clock in product(_ORDERS, _CLOCKS):
        for joint in " T" if clock and not set("bB") & set(order) else " ":
            if clock:
                found += [Shape(f"{order}{joint}{clock}{p}{z}") for p in ("", " p", "p") for z in ("", "z", " z")]
            else:
                found.append(Shape(order))
    return found


SHAPES = _shapes()
#: What is tried without a sample: every order of a date, with and without the commonest times.
_USUAL = [Shape(f"{order}{clock}") for order in _ORDERS for clock in ("", " H:M", " H:M p", " H:M:S")]


def _date_parts(fmt: DateFormat, text: str) -> tuple[int, int] | None:
    match = re.match(fmt.pattern, text, re.ASCII)
    if not match:
        return None
    slots = [int(n) for n in re.findall(r"\$(\d)", fmt.iso)[:3]]
    return int(match[slots[1]]), int(match[slots[2]])


def guess_format(first: str | None) -> DateFormat | Shape | None:
    """The format of one sample value; month-first wins unless it is impossible."""
    if not first:
        return None
    for fmt in FORMATS:
        parts = _date_parts(fmt, first)
        if parts and 1 <= parts[0] <= 12 and 1 <= parts[1] <= 31:
            return fmt
    for shape in SHAPES:
        if shape.fits(first):
            match = re.match(shape.pattern, first, re.ASCII)
            return Shape(shape.tokens, _offset_minutes(match[len(shape.fields())])) if "z" in shape.tokens else shape
    return None


def text_to_timestamp(col: Column, fmt: DateFormat | Shape | None) -> Column:
    """Parse with the guessed format; without one, take the first that fits, month-first before day-first."""
    if fmt is not None:
        return fmt.parse(col)
    return F.coalesce(*[f.parse(col) for f in [*FORMATS, *_USUAL]])


def to_timestamp(col: Column, dtype: T.DataType, fmt: DateFormat | Shape | None = None) -> Column:
    """Coerce a column to a timestamp without time zone; failures become NULL."""
    if isinstance(dtype, T.StringType):
        return text_to_timestamp(col, fmt)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):  # nanoseconds since the epoch
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        micros = F.floor(col / F.lit(1000)).try_cast("long")
        day = F.lit(86_400_000_000)
        days = F.floor(micros / day).cast("int")
        seconds = F.pmod(micros, day).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")
        zero = F.lit(0)
        return start + F.make_dt_interval(days, zero, zero, seconds.cast("decimal(18,6)"))
    raise TypeError(f"cannot convert {dtype.simpleString()} to a date")
