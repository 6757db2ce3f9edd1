"""Terms of featuring and expiry, pay as boards write it, contents and dates in odd forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DAYS, MOST_DAYS = 30, 365


def expiry_days(override: Column, requested: Column, default: int = DEFAULT_DAYS) -> tuple[Column, Column]:
    """(days, source): the moderator's number, else the requested one, else the default; 1 to 365."""
    days = F.least(F.greatest(F.coalesce(override, requested, F.lit(default)), F.lit(1)), F.lit(MOST_DAYS))
    return days, F.when(override.isNotNull(), "override").when(requested.isNotNull(), "requested").otherwise("default")


def featured_until(as_of: Column, days: Column) -> Column:
    return F.date_add(as_of, days.cast("int"))


def featured_since(current: Column, until: Column, as_of: Column) -> Column:
    """When featuring began: as before while it is still live, else now."""
    return F.when(current.isNotNull() & (until.isNull() | (until >= as_of)), current).otherwise(as_of)


def salary_text(pay: str, low: str = "min", high: str = "max", currency: str = "currency", period: str = "period") -> Column:
    """`50000 - 60000 EUR / year` of a pay object in a variant column; null without amounts."""
    ends = F.array_compact(F.array(*[F.try_variant_get(pay, f"$.{k}", "string") for k in (low, high)]))
    tail = F.concat_ws(" / ", F.try_variant_get(pay, f"$.{currency}", "string"), F.try_variant_get(pay, f"$.{period}", "string"))
    return F.when(F.size(ends) > 0, F.rtrim(F.concat_ws(" ", F.array_join(ends, " - "), tail)))


def decoded_content(text: Column) -> Column:
    """The text of a field that may be base64: decoded where that gives text with a blank or a tag, else as it is."""
    tight = F.regexp_replace(text, r"\s+", "")
    plain = F.try_validate_utf8(F.try_to_binary(tight, F.lit("base64")).cast("string"))
    return F.when(tight.rlike(r"^[A-Za-z0-9+/]{8,}={0,2}$") & (F.length(tight) % 4 == 0) & plain.rlike(r"[ <]"), plain).otherwise(text)


#: forms of dates on boards, tried in order
DATE_FORMS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "EEE MMM dd HH:mm:ss zzz yyyy")


def _like(text: Column, form: str) -> Column:
    """Whether a text has the marks of a form of day, month and year, and a month's name as long as it asks for: trying a form on another text raises an exception inside."""
    if not re.fullmatch("[dMy ,./]+", form):
        return F.lit(True)
    marks = [text.contains(mark) == F.lit(mark in form) for mark in ",./"]
    month = {"MMMM": "(?i)[a-z]{4}|may", "MMM": "(?i)(?<![a-z])[a-z]{3,4}(?![a-z])"}.get("M" * form.count("M"))
    return reduce(Column.__and__, marks + ([text.rlike(month)] if month else []))


def written_date(text: Column, forms: Sequence[str] = DATE_FORMS) -> Column:
    """A date written in one of the forms; `Date.toString` of Java among them."""
    plain = F.regexp_replace(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]* ", "")
    read = lambda text, form: F.when(_like(text, form), F.try_to_timestamp(text, F.lit(form)).cast("date"))
    usual = [read(plain, f) for f in forms if "EEE" not in f]
    # the zone's name in between is left out: a date needs none
    stamp = F.regexp_replace(plain, r"^([A-Z][a-z]{2} \d{1,2}) \d\d:\d\d:\d\d \S+ (\d{4})$", "$1, $2")
    return F.coalesce(*usual, read(stamp, "MMM d, yyyy"), read(stamp, "MMM dd, yyyy"))


def joined_places(parts: Sequence[Column], mark: str = ", ") -> Column:
    """The parts that have a value, each once, in order; null if none has."""
    found = F.array_distinct(F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) > 0, F.array_join(found, mark))


def listed_places(places: Column, limit: int | None = 10) -> Column:
    """Distinct names of an array of places, joined by `; `: of the first `limit`, or of all for None."""
    found = F.array_distinct(F.filter(F.transform(places if limit is None else F.slice(places, 1, limit), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))
