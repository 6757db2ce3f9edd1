"""Dates of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLISECONDS_FROM = 1e11


def parse_date(value: Column) -> Column:
    """A date from epoch seconds or milliseconds, or from ISO 8601 text; null otherwise."""
    # no number has a hyphen after a digit; trying to read one in a date raises an exception inside, for each row
    number = F.when(~value.rlike(r"\d-"), value.try_cast("double"))
    seconds = F.when(number > MILLISECONDS_FROM, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds).cast("date")).otherwise(F.to_date(F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))))


def relative_date(text: Column, as_of: Column) -> Column:
    """Posted Today / Yesterday / n Days Ago / n Weeks Ago, seen on as_of."""
    n = F.regexp_extract(text, r"(?i)(\d+)\+?\s*(?:day|week)", 1).try_cast("int")
    return (
        F.when(text.rlike("(?i)today"), as_of)
        .when(text.rlike("(?i)yesterday"), F.date_sub(as_of, 1))
        .when(text.rlike(r"(?i)\d+\+?\s*week"), F.date_sub(as_of, n * 7))
        .when(text.rlike(r"(?i)\d+\+?\s*day"), F.date_sub(as_of, n))
    )


def seen_date(posted: Column, created: Column) -> Column:
    return F.coalesce(posted, created.cast("date"))
