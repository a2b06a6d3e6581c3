"""Dates as text, covariates, and calendars other than the proleptic Gregorian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDARS = ("proleptic_gregorian", "standard", "gregorian", "noleap", "365_day", "360_day")


def to_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def from_text(text: Column) -> Column:
    """Dates written as year, month and day with hyphens; missing where there is no such day."""
    part = F.split(text, "-")
    return F.try_to_date(F.concat_ws("-", F.lpad(part[0], 4, "0"), F.lpad(part[1], 2, "0"), F.lpad(F.substring(part[2], 1, 2), 2, "0")), "yyyy-MM-dd")


def ordinal(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """Days since the calendar's 1970-01-01."""
    if calendar not in CALENDARS:
        raise ValueError(f"unknown calendar {calendar}")
    if calendar == "360_day":
        return (year - 1970) * 360 + (month - 1) * 30 + day - 1
    if calendar in ("noleap", "365_day"):
        before = F.array(*[F.lit(n) for n in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)])
        return (year - 1970) * 365 + before[month - 1] + day - 1
    return F.unix_date(F.make_date(year, month, day))


def switch_calendar(year: Column, month: Column, day: Column) -> Column:
    """The proleptic Gregorian date of that name; missing where it has none (30 February)."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def covariate(time: Column, what: str = "year") -> Column:
    """A time as a number: its year, or days since 1970-01-01."""
    if what not in ("year", "days"):
        raise ValueError(f"unknown covariate {what}")
    return F.year(time) if what == "year" else F.unix_date(time.cast("date")).cast("double")
