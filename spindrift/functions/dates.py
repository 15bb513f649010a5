"""Dates out of messy cells. What can't be a day of the calendar is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import wide_clean


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def parse_deadline(c: Column) -> Column:
    """Curated rows. The first m/d/y anywhere in the cell decides, even inside an ISO date, which therefore mostly fails.

    A whole cell that only says "rolling", "TBD" and the like is null. Of free forms "March 15, 2026" and "June 2026" are read.
    """
    s = F.trim(c)
    us = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    iso = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    part = lambda p, i: F.regexp_extract(s, p, i)
    year = F.when(F.length(part(us, 3)) == 2, F.concat(F.lit("20"), part(us, 3))).otherwise(part(us, 3))
    month = r"(?i)^([a-z]{3})[a-z]*\.? (?:(\d{1,2}),? )?(\d{4})$"
    names = F.split(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), " ")
    number = F.array_position(names, F.lower(part(month, 1))).cast("string")
    day = F.when(part(month, 2) == "", F.lit("1")).otherwise(part(month, 2))
    free = F.when((number != "0") & (part(month, 3).cast("int") > 2000), _day(part(month, 3), number, day))
    return (
        F.when(s.isNull() | s.rlike(r"(?i)^(?:asap|n/?a|none|ongoing|open|rolling|tbd|)$"), F.lit(None).cast("date"))
        .when(s.rlike(us), _day(year, part(us, 1), part(us, 2)))
        .when(s.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike("(?i)until filled|rolling basis|no deadline"), F.lit(None).cast("date"))
        .when(s.rlike(month), free)
    )


def parse_iso_date(c: Column) -> Column:
    """Feeds: a date, a date and time (the day in UTC), m/d/yyyy or yyyy/mm/dd, as the whole cell."""
    s = wide_clean(c)
    stamp = r"^(\d{4}-\d{2}-\d{2})[T ]([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(\.\d{1,3})?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"
    part = lambda p, i: F.regexp_extract(s, p, i)
    zone = F.when(part(stamp, 6).isin("", "Z"), F.lit("+00:00")).otherwise(part(stamp, 6))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    shift = sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int"))
    minutes = part(stamp, 2).cast("int") * 60 + part(stamp, 3).cast("int") - shift
    us, slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})/(\d{2})/(\d{2})$"
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
        .when(s.rlike(stamp), F.date_add(F.try_to_date(part(stamp, 1), "yyyy-MM-dd"), F.floor(minutes / 1440).cast("int")))
        .when(s.rlike(us), _day(part(us, 3), part(us, 1), part(us, 2)))
        .when(s.rlike(slashed), _day(part(slashed, 1), part(slashed, 2), part(slashed, 3)))
    )


def parse_stamp(c: Column) -> Column:
    """A strict RFC 3339 time as UTC text with milliseconds, or null."""
    s = F.trim(c)
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    # zones with odd offsets are read by Spark's own parser; seconds are cut at milliseconds
    return F.when(ok, F.date_format(F.try_to_timestamp(s), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def deadline_kind(raw: Column, parsed: Column) -> Column:
    rolling = raw.rlike("(?i)no deadline|ongoing|open until|rolling|until filled")
    return F.when(parsed.isNotNull(), "hard").when(F.coalesce(rolling, F.lit(False)), "rolling").otherwise("unknown")


def days_until(deadline: Column, now: Column) -> Column:
    """Whole days from ``now`` to the deadline's midnight in UTC, rounded down: today's is -1 from its first second on."""
    gap = F.unix_millis(deadline.cast("timestamp")) - F.unix_millis(now)
    return F.floor(gap / F.lit(86_400_000.0)).cast("int")
