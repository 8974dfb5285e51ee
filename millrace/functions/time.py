"""Time and duration functions. Times are microsecond timestamps in UTC; nanoseconds are rounded down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the literal suffixes; nanoseconds are handled apart.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
#: The order in which text is tried as a time.
PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def now() -> Column:
    return F.current_timestamp()


def from_seconds(n: Column) -> Column:
    return F.timestamp_seconds(n)


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n)


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n)


def from_nanos(n: Column) -> Column:
    return F.timestamp_micros(F.floor(n / 1000))


def seconds(t: Column) -> Column:
    return F.unix_seconds(t)


def nanoseconds(t: Column) -> Column:
    return F.unix_micros(t) * 1000


def year(t: Column) -> Column:
    return F.year(t)


def from_string(s: Column, pattern: str) -> Column:
    return F.to_timestamp(s, pattern)


def into_string(t: Column, pattern: str) -> Column:
    return F.date_format(t, pattern)


def parse(s: Column) -> Column:
    """The first of PATTERNS that fits, else seconds since the epoch, else null. A weekday before the date is left out."""
    s = F.regexp_replace(s, "^[A-Za-z]{3}, *", "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in PATTERNS], F.timestamp_seconds(s.try_cast("long")))


def div_floor(t: Column, duration_us: int) -> Column:
    us = F.unix_micros(t)
    return ((us - F.pmod(us, F.lit(duration_us))) / duration_us).cast("long")


def zero() -> Column:
    return F.timestamp_seconds(F.lit(0))


def duration(n: int, unit: str) -> Column:
    """A literal such as 5s as an interval."""
    us = n // 1000 if unit == "ns" else n * UNITS[unit]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(us / 1e6).cast("decimal(18,6)"))


def duration_micros(d: Column) -> Column:
    part = lambda name: F.extract(F.lit(name), d).cast("long")
    small = (F.extract(F.lit("SECOND"), d) * 10**6).cast("long")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60 * 10**6 + small


def add(t: Column, d: Column) -> Column:
    return t + d


def subtract(t: Column, d: Column) -> Column:
    return t - d


def scale(t: Column, factor: Column) -> Column:
    """A time's distance from the epoch, multiplied."""
    return F.timestamp_micros((F.unix_micros(t) * factor).cast("long"))


#: Microseconds of the units that durations are made from and taken in; nanoseconds are a thousandth.
_IN = {"weeks": UNITS["w"], "days": UNITS["d"], "hours": UNITS["h"], "minutes": UNITS["m"], "seconds": UNITS["s"], "milliseconds": UNITS["ms"], "microseconds": UNITS["us"]}


def duration_of(n: Column, unit: str) -> Column:
    """A duration of n of a unit by name, such as minutes; nanoseconds are rounded down to microseconds."""
    us = F.floor(n / 1000) if unit == "nanoseconds" else n * _IN[unit]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def duration_in(d: Column, unit: str) -> Column:
    """The whole number of a unit in a duration, towards zero."""
    us = duration_micros(d)
    return us * 1000 if unit == "nanoseconds" else F.call_function("div", us, F.lit(_IN[unit]))
