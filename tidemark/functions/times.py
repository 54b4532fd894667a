"""Local days, weekends, labels and ISO strings. `as_of` is always given: queries never read a clock."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
#: Fixed value: English months, as abbreviations.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"


def instant(c: Column) -> Column:
    """A timestamp without zone, read as UTC; needs a session in UTC."""
    return c.cast("timestamp")


def local(c: Column, zone: str = ZONE) -> Column:
    """Wall-clock timestamp of an instant in the zone."""
    return F.from_utc_timestamp(instant(c), zone)


def local_day(c: Column, zone: str = ZONE) -> Column:
    """yyyy-MM-dd of an instant in the zone."""
    return F.date_format(local(c, zone), "yyyy-MM-dd")


def local_weekday(c: Column, zone: str = ZONE) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(local(c, zone)) - 1


def day_of(as_of: dt.datetime, zone: str = ZONE) -> dt.date:
    """Local day of an as-of instant (without zone: UTC)."""
    return (as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.UTC)).astimezone(ZoneInfo(zone)).date()


def weekend_listing(as_of: dt.datetime, zone: str = ZONE) -> list[str]:
    """The next Friday, Saturday and Sunday, each on or after the day: on a Saturday that includes next week's Friday."""
    day = day_of(as_of, zone)
    return sorted((day + dt.timedelta((t - day.isoweekday()) % 7)).isoformat() for t in (5, 6, 7))


def weekend_range(as_of: dt.datetime, zone: str = ZONE) -> tuple[str, str]:
    """First and last day of the coming weekend; one that has begun starts today and ends on its Sunday."""
    day = day_of(as_of, zone)
    to_friday = 0 if day.isoweekday() >= 6 else 5 - day.isoweekday()
    return (day + dt.timedelta(to_friday)).isoformat(), (day + dt.timedelta((7 - day.isoweekday()) % 7)).isoformat()


def date_label(c: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(c, zone), "EEE, MMM d")


def long_date_label(c: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(c, zone), "EEEE, MMMM d, yyyy")


def time_label(c: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(c, zone), "h:mm a")


def time_range_label(start: Column, end: Column, all_day: Column, zone: str = ZONE) -> Column:
    both = F.concat_ws(" – ", time_label(start, zone), time_label(end, zone))
    return F.when(F.coalesce(all_day, F.lit(False)), F.lit("Time not listed")).otherwise(both)


def when_label(start: Column, end: Column, all_day: Column, zone: str = ZONE) -> Column:
    day, time = long_date_label(start, zone), time_range_label(start, end, all_day, zone)
    return F.when(F.coalesce(all_day, F.lit(False)), F.concat(day, F.lit(" (time not listed)"))).otherwise(F.concat(day, F.lit(", "), time))


def relative_label(c: Column, as_of: dt.datetime, zone: str = ZONE) -> Column:
    """Today, Tomorrow or the date."""
    day = F.datediff(local(c, zone).cast("date"), F.lit(day_of(as_of, zone)))
    return F.when(day == 0, "Today").when(day == 1, "Tomorrow").otherwise(date_label(c, zone))


def clock(c: Column) -> Column:
    """HH:mm of a text with h, h:mm and am or pm; null without."""
    rx = r"(?i)(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?"
    hour = F.try_to_number(F.regexp_extract(c, rx, 1), F.lit("99")).cast("int") % 12
    hour = hour + F.when(F.lower(F.regexp_extract(c, rx, 3)) == "p", 12).otherwise(0)
    minute = F.regexp_extract(c, rx, 2)
    return F.when(c.rlike(rx), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute)))


DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "M/d/yyyy", "d MMMM yyyy", "d MMM yyyy")


def parse_date(c: Column, year: int | None = None) -> Column:
    """Date of a text: ISO, month name and day (with `year` if it has none), or month/day/year; null if it has none."""
    text = F.regexp_replace(c, r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b\.?,?", " ")
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    us = F.regexp_extract(text, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    rx = rf"(?i)\b({MONTH})\s*(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*[-–]\s*\d{{1,2}})?(?:,?\s*(\d{{4}}))?\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(text, rx, 1), 1, 3)))
    own = F.regexp_extract(text, rx, 3)
    named = F.concat_ws("-", F.when(own == "", F.lit(str(year)) if year else None).otherwise(own), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, rx, 2), 2, "0"))
    named = F.when(text.rlike(rx) & ((own != "") | F.lit(year is not None)), named)
    day = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("date")
    return F.coalesce(day(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), day(named, "yyyy-MM-dd"), day(F.nullif(us, F.lit("")), "M/d/yyyy"))


def offset(day: Column, policy: str = "fixed", zone: str = ZONE) -> Column:
    """UTC offset of a local day: `fixed` -07:00; `month` -07:00 from March to November, else -08:00; `zone` as the zone has it."""
    if policy == "fixed":
        return F.lit("-07:00")
    if policy == "month":
        return F.when(F.month(day).between(3, 11), "-07:00").otherwise("-08:00")
    noon = F.date_add(day, 0).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    minutes = ((noon.cast("long") - F.to_utc_timestamp(noon, zone).cast("long")) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(sign, part(F.floor(F.abs(minutes) / 60)), F.lit(":"), part(F.abs(minutes) % 60))


def iso_start(date_text: Column, time_text: Column, year: int | None = None, policy: str = "fixed") -> Column:
    """struct(iso, day, had_time) of a date and an optional time; without one noon stands in."""
    rx = r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})"
    full = date_text.rlike(rx)
    day = F.when(full, parse_date(F.regexp_extract(date_text, rx, 1))).otherwise(parse_date(date_text, year))
    plain = F.regexp_extract(F.coalesce(time_text, F.lit("")), r"(\d{1,2}:\d{2})\s*$", 1)
    time = F.when(full, F.regexp_extract(date_text, rx, 2)).otherwise(F.coalesce(clock(time_text), F.when(plain != "", F.lpad(plain, 5, "0"))))
    iso = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.coalesce(time, F.lit("12:00")), F.lit(":00"), offset(day, policy))
    return F.when(day.isNotNull(), F.struct(iso.alias("iso"), day.alias("day"), time.isNotNull().alias("had_time")))


def month_days(first: Column) -> Column:
    """The days of the month of a date, padded with nulls to whole weeks from Sunday."""
    start, end = F.trunc(first, "MM"), F.last_day(first)
    before = F.dayofweek(start) - 1
    days = F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    after = F.pmod(-(before + F.size(days)), F.lit(7)).cast("int")
    blank = lambda n: F.array_repeat(F.lit(None).cast("date"), n)
    return F.concat(blank(before), days, blank(after))
