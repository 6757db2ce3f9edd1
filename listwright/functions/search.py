"""Word search: terms of a query text, prefix or whole-word patterns, match and rank."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS, WHOLE_WORD_LENGTH = 8, 4


def terms(text: str | None) -> list[str]:
    """Lower-cased words without edge marks (but `+`, `#` and a leading point), distinct, eight at most."""
    found = (re.sub(r"^[^\w+#.]+|[^\w+#]+$", "", x) for x in (text or "").lower().split())
    return list(dict.fromkeys(x for x in found if x))[:MAX_TERMS]


def pattern(term: str) -> str:
    escaped = re.sub(r"([^\w\s])", r"\\\1", term)
    return "(?i)(^|[^a-z0-9])" + escaped + ("($|[^a-z0-9])" if len(term) <= WHOLE_WORD_LENGTH else "")


def _any(columns: list[Column], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.rlike(pattern(term)), F.lit(False))
    return out


def matches(text: str | None, headline: list[Column], body: list[Column]) -> Column:
    """Every term is in some column; all rows if there is no term."""
    out = F.lit(True)
    for t in terms(text):
        out = out & _any([*headline, *body], t)
    return out


def rank(text: str | None, headline: list[Column]) -> Column:
    """0 where every term is in the headline, else 1."""
    out = F.lit(True)
    for t in terms(text):
        out = out & _any(headline, t)
    return F.when(out, 0).otherwise(1)
