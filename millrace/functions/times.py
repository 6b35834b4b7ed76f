"""Times: epoch nanoseconds as long (microseconds lose boundaries), zones by row, local days and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import trimmed

DAY = 86_400 * 10**9
#: Marks a stored text time that cannot be read.
CORRUPT = -(2**63)


def micros(time: Column) -> Column:
    """Epoch microseconds of a timestamp without zone, taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time)


def nanos(time: Column) -> Column:
    return micros(time) * F.lit(1000)


def whole(nano: Column, unit: int) -> Column:
    """How many times `unit` goes into nanoseconds, rounded down: whole numbers only, as doubles are 256 nanoseconds apart here."""
    return F.call_function("div", nano - F.pmod(nano, F.lit(unit)), F.lit(unit))


def from_nanos(nano: Column) -> Column:
    """A timestamp without zone, in UTC, cut to microseconds."""
    return F.timestamp_add("MICROSECOND", whole(nano, 1000), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def local(now: str, zone: Column) -> Column:
    """The wall clock (a timestamp without zone) at a UTC time such as '2024-01-08 12:00:00'."""
    return F.convert_timezone(F.lit("UTC"), zone, F.expr(f"TIMESTAMP_NTZ'{now}'"))


def local_date(now: str, zone: Column) -> Column:
    return F.date_format(local(now, zone), "yyyy-MM-dd")


def utc_nanos(wall: Column, zone: Column) -> Column:
    """Epoch nanoseconds of a wall clock in a zone."""
    return nanos(F.convert_timezone(zone, F.lit("UTC"), wall))


def day_window(now: str, zone: Column) -> tuple[Column, Column]:
    """The local calendar day at `now` as [from, until) in epoch nanoseconds: 23 or 25 hours where clocks change."""
    day = F.date_trunc("day", local(now, zone)).cast("timestamp_ntz")
    return utc_nanos(day, zone), utc_nanos(F.timestamp_add("DAY", F.lit(1), day), zone)


def due_at(now: str, zone: Column, clock: Column) -> Column:
    """Epoch nanoseconds of today's local clock time (HH:MM)."""
    wall = F.concat(F.date_format(local(now, zone), "yyyy-MM-dd "), clock, F.lit(":00")).cast("timestamp_ntz")
    return utc_nanos(wall, zone)


def schedule_due(now: str, now_nano: int, zone: Column, clock: Column, last: Column | None = None) -> Column:
    """Whether today's run is due: the clock has passed, and the last run (epoch nanoseconds, null: never) was before it."""
    at = due_at(now, zone, clock)
    due = F.lit(now_nano) >= at
    return due if last is None else due & (last.isNull() | (last < at))


def valid_clock(clock: Column) -> Column:
    return clock.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")


def feed_time(text: Column) -> Column:
    """Epoch microseconds of a feed's date in RFC 3339, RFC 1123 or RFC 822, numeric or named zone; null where none fits."""
    t = trimmed(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    named = F.regexp_replace(plain, " (GMT|UTC|UT|Z)$", " +0000")
    year = F.regexp_replace(named, r"^(\d{1,2} [A-Za-z]{3}) (\d{2}) ", "$1 20$2 ")
    padded = F.regexp_replace(year, r"^(\d) ", "0$1 ")
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.regexp_replace(t, r"(\.\d{6})\d+", "$1")))
    at = F.coalesce(iso, F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm Z")))
    return F.unix_micros(at)


def rfc3339(nano: Column) -> Column:
    """UTC text with as many fractional digits as needed; empty for null."""
    whole = F.date_format(from_nanos(nano), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.rtrim(F.lpad((F.pmod(nano, F.lit(10**9))).cast("string"), 9, "0"), F.lit("0"))
    return F.coalesce(F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z")), F.lit(""))


def parse_rfc3339(text: Column) -> Column:
    """Epoch nanoseconds of stored text: null for the empty string, CORRUPT where it cannot be read."""
    shape = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?Z$"
    base = F.try_to_timestamp(F.concat(F.regexp_extract(text, shape, 1), F.lit("Z")))
    part = F.rpad(F.regexp_extract(text, shape, 2), 9, "0").cast("long")
    known = F.when(text.rlike(shape), F.unix_micros(base) * F.lit(1000) + part)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("long")).otherwise(F.coalesce(known, F.lit(CORRUPT)))
