"""Calendar arithmetic, all in UTC: durations and boundaries on the driver, truncation and text as Columns.

Time is epoch seconds or microseconds in a bigint.  Columns are built from integers,
dates and TIMESTAMP_NTZ only, so the session's time zone never matters.
"""

from __future__ import annotations

import calendar
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("year", "month", "week", "day", "hour", "minute", "second")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Formats that name a unit and no text form.
NUMERIC_FORMATS = ("", "posix", "millis", "micros")


@dataclass(frozen=True)
class Duration:
    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Duration:
        m = re.match(r"\s*(\d+)\s+(\w+)", text)
        if not m or int(m[1]) <= 0:
            raise ValueError(f"Wrong duration description: {text}")
        # The last letter is the plural's.
        return cls(int(m[1]), unit(m[2][:-1]))

    def before(self, now: int) -> int:
        """``now`` less this duration; days beyond a month's end run over into the next (31 March - 1 month = 3 March)."""
        y, mo, d, h, mi, s = time.gmtime(now)[:6]
        if self.unit in ("year", "month"):
            months = y * 12 + mo - 1 - self.count * (12 if self.unit == "year" else 1)
            return calendar.timegm((months // 12, months % 12 + 1, 1, h, mi, s)) + (d - 1) * 86400
        return now - self.count * (7 * 86400 if self.unit == "week" else SECONDS[self.unit])

    def days(self) -> float:
        """An order for durations."""
        return self.count * {"year": 365.25, "month": 30.44, "week": 7, "day": 1}.get(self.unit, SECONDS.get(self.unit, 0) / 86400)


def unit(name: str) -> str:
    if name not in UNITS:
        raise ValueError(f"Unsupported time unit: {name}")
    return name


def granularity(name: str) -> str:
    """A unit that time can be truncated to."""
    if unit(name) == "week":
        raise ValueError("Unsupported granularity: week")
    return name


def _scale(micro: bool) -> int:
    return 1_000_000 if micro else 1


def _days(ts: Column, micro: bool) -> Column:
    return ((ts - F.pmod(ts, F.lit(86400 * _scale(micro)))) / F.lit(86400 * _scale(micro))).cast("int")


def truncated(ts: Column, to: str, micro: bool) -> Column:
    if to in SECONDS:
        return ts - F.pmod(ts, F.lit(SECONDS[to] * _scale(micro)))
    day = F.date_from_unix_date(_days(ts, micro))
    first = F.make_date(F.year(day), F.month(day) if to == "month" else F.lit(1), F.lit(1))
    return F.unix_date(first).cast("bigint") * F.lit(86400 * _scale(micro))


def rolled_up(ts: Column, rules: list[tuple[str, Duration]], now: int, micro: bool) -> Column:
    """``ts`` truncated by the first rule whose age it exceeds, oldest rule first."""
    out = None
    for to, after in sorted(rules, key=lambda r: -r[1].days()):
        limit = after.before(now) * _scale(micro)
        out = (F.when if out is None else out.when)(ts < F.lit(limit), truncated(ts, to, micro))
    return ts if out is None else out.otherwise(ts)


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _pieces(form: str) -> list[str]:
    form = form.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%R", "%H:%M")
    return [p for p in re.split(r"(%.)", form) if p]


def formatted(ts: Column, form: str, micro: bool) -> Column:
    """The text of a time by strftime letters; a unit's name, or none, gives the raw number."""
    if form in NUMERIC_FORMATS:
        return ts.cast("string")
    seconds = (ts - F.pmod(ts, F.lit(_scale(micro)))) / F.lit(_scale(micro)) if micro else ts
    seconds = seconds.cast("bigint")
    day = F.date_from_unix_date(_days(ts, micro))
    clock = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = lambda c, n: ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("int")
    known = {
        "%Y": lambda: F.lpad(F.year(day).cast("string"), 4, "0"), "%m": lambda: two(F.month(day)), "%d": lambda: two(F.dayofmonth(day)),
        "%y": lambda: two(F.year(day) % 100), "%j": lambda: F.lpad(F.dayofyear(day).cast("string"), 3, "0"),
        "%b": lambda: F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(day)), "%a": lambda: F.element_at(F.array(*map(F.lit, _WEEKDAYS)), F.weekday(day) + 1),
        "%H": lambda: two(whole(clock, 3600)), "%M": lambda: two(F.pmod(whole(clock, 60), F.lit(60))), "%S": lambda: two(F.pmod(clock, F.lit(60)).cast("int")), "%%": lambda: F.lit("%"),
    }
    parts = []
    for p in _pieces(form):
        if p[0] == "%" and p not in known:
            raise ValueError(f"Unsupported time format: {p}")
        parts.append(known[p]() if p in known else F.lit(p))
    return F.concat(*parts)


_FIELDS = {"%Y": r"(\d{4})", "%m": r"(\d{1,2})", "%d": r"(\d{1,2})", "%H": r"(\d{1,2})", "%M": r"(\d{1,2})", "%S": r"(\d{1,2})", "%y": r"(\d{2})", "%j": r"(\d{1,3})", "%b": r"([A-Za-z]{3})"}


def parsed(c: Column, form: str, micro: bool) -> Column:
    """Epoch time of texts.  Integers are in the unit that ``form`` names, else in the column's own."""
    if form in NUMERIC_FORMATS:
        n = F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("bigint")
        per = {"": _scale(micro), "posix": 1, "millis": 1000, "micros": 1_000_000}[form]
        to = _scale(micro)
        value = n * F.lit(to // per) if to >= per else ((n - F.pmod(n, F.lit(per // to))) / F.lit(per // to)).cast("bigint")
        return F.coalesce(value, F.raise_error(F.concat(F.lit("Can't parse as time: "), c)).cast("bigint"))
    pattern, at = "^", {}
    for p in _pieces(form):
        if p in _FIELDS:
            at[p] = len(at) + 1
            pattern += _FIELDS[p]
        elif p[0] == "%":
            raise ValueError(f"Unsupported time format: {p}")
        else:
            pattern += re.escape(p)
    # Fields that the format doesn't have are those of 1970-01-01 00:00:00.
    number = lambda p, default: F.regexp_extract(c, pattern, at[p]).try_cast("int") if p in at else F.lit(default)
    year = number("%Y", 1970) if "%y" not in at else number("%y", 70) + F.when(number("%y", 70) < 69, 2000).otherwise(1900)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.initcap(F.regexp_extract(c, pattern, at["%b"]))).cast("int") if "%b" in at else number("%m", 1)
    valid = month.between(1, 12) & number("%d", 1).between(1, 31)
    day = F.unix_date(F.make_date(year, F.when(valid, month), F.lit(1))) + (number("%j", 1) if "%j" in at else number("%d", 1)) - 1
    seconds = day.cast("bigint") * 86400 + number("%H", 0) * 3600 + number("%M", 0) * 60 + number("%S", 0)
    value = seconds * F.lit(_scale(micro))
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"Can't parse as {form}: "), c)).cast("bigint"))


def from_timestamp(c: Column, kind: str, micro: bool) -> Column:
    """Epoch time of a DATE, TIMESTAMP or TIMESTAMP_NTZ column; the latter is taken as UTC."""
    if kind == "date":
        return F.unix_date(c).cast("bigint") * F.lit(86400 * _scale(micro))
    micros = F.unix_micros(c) if kind == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return micros if micro else ((micros - F.pmod(micros, F.lit(1_000_000))) / F.lit(1_000_000)).cast("bigint")


def literal(text: str, micro: bool) -> int:
    """A time in a filter: digits in the column's unit, or a date with or without a time of day, in UTC."""
    if text.isdigit():
        value = int(text)
    else:
        m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{2}):(\d{2})(\.\d{1,6})?)?", text.strip())
        if not m:
            raise ValueError(f"Unrecognized time format: {text}")
        value = calendar.timegm(tuple(int(x or 0) for x in m.groups()[:6]))
        if micro:
            value = value * 1_000_000 + int(((m[7] or ".")[1:] + "000000")[:6])
    if value <= 0:
        raise ValueError(f"Unrecognized time format: {text}")
    return value
