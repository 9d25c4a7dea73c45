"""Review dates and calendar buckets, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quibble.functions.text import to_number


def parse_date(c: Column, month_first_text: bool = False) -> Column:
    """Date from ``2018-09-13``, ``09/13/2018`` or ``13-Sep-2018``, else null.

    ``month_first_text`` also reads the ``09 13, 2018`` form.
    """
    formats = [
        (r"^\d{4}-\d{1,2}-\d{1,2}", None),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    ]
    if month_first_text:
        formats.append((r"^\d{1,2} \d{1,2}, \d{4}$", "M d, yyyy"))
    parsed = [F.when(c.rlike(shape), F.try_to_date(c, f) if f else F.try_to_date(c)) for shape, f in formats]
    return F.coalesce(*parsed)


def epoch_date(c: Column) -> Column:
    """UTC day of an epoch-seconds text."""
    days = F.floor(to_number(c) / F.lit(86400)).try_cast("int")
    return F.date_from_unix_date(days)


def review_date(text: Column, epoch: Column, month_first_text: bool = False) -> Column:
    return F.coalesce(parse_date(text, month_first_text), epoch_date(epoch))


def week_start(c: Column) -> Column:
    return F.trunc(c, "week")


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")
