"""Dates of birth and ages in completed years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted date-of-birth formats, tried in this order.
DOB_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd"]


def iso_date(c: Column) -> Column:
    """Date of an ISO text; null on anything else (ANSI mode would fail on a plain cast)."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def parse_dob(c: Column) -> Column:
    raw = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in DOB_FORMATS])


def _month_day(c: Column) -> Column:
    return F.month(c) * 100 + F.dayofmonth(c)


def full_years(start: Column, end: Column) -> Column:
    return F.year(end) - F.year(start) - (_month_day(end) < _month_day(start)).cast("int")


def age_years(dob: Column, as_of: Column) -> Column:
    """Duration in whole years, cut towards zero, so a birth next month is 0 and not -1."""
    return F.when(dob <= as_of, full_years(dob, as_of)).otherwise(-full_years(as_of, dob))


def age_calendar(dob: Column, as_of: Column) -> Column:
    """Year difference less one before the birthday; a birth in the future is negative at once."""
    return full_years(dob, as_of)


def derive_age(raw: Column, as_of: Column) -> Column:
    """Age from the first ten characters, else from a leading year; never below zero."""
    text = F.trim(raw)
    year = F.regexp_extract(text, r"^(\d{4})", 1)
    born = F.coalesce(
        iso_date(F.substring(text, 1, 10)),
        F.when(year != "", iso_date(F.concat(year, F.lit("-01-01")))),
    )
    return F.when(born.isNotNull(), F.greatest(full_years(born, as_of), F.lit(0)))
