"""Salaries in free text: a text is read as tokens, and neighbouring tokens as amounts and ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: signs and codes of currencies, codes that may follow a single amount, and what stands between the ends of a range
SIGNS = {"$": "USD", "£": "GBP", "€": "EUR"}
CODES, SIGNED_CODES = ("USD", "EUR", "GBP", "CAD", "AUD", "CHF", "SEK", "NOK", "DKK"), ("USD", "EUR", "GBP")
BETWEEN = ("-", "–", "—", "~", "to", "and")
#: hours of a year's work, the wages an hour that are made yearly, and yearly amounts that are believed
HOURS_A_YEAR, HOURLY, LEAST, MOST = 2080, range(15, 200), 10_000, 2_000_000

_TOKEN = re.compile(r"\d{1,3}(?:[,.]\d{3})+|\d+(?:\.\d+)?|[A-Za-z]+|\S")


@dataclass
class Amount:
    """A number among the tokens first..last, with a sign or code in front and a mark of thousands behind."""

    first: int
    last: int
    value: int
    mark: str | None
    thousands: bool

    def whole(self, other_in_thousands: bool = False) -> int:
        return self.value * 1000 if self.thousands or (other_in_thousands and self.value < 1000) else self.value


def yearly(value: int) -> int:
    return value * HOURS_A_YEAR if value in HOURLY else value


def believed(value: int) -> bool:
    return LEAST <= value <= MOST


def amounts(tokens: list[str]) -> list[Amount]:
    found = []
    for i, token in enumerate(tokens):
        if token[0].isdecimal() and token[0].isascii():
            before = tokens[i - 1] if i else ""
            mark = before if before in SIGNS or before in CODES else None
            thousands = i + 1 < len(tokens) and tokens[i + 1] in ("k", "K")
            found.append(Amount(i - (mark is not None), i + thousands, int(float(token.replace(",", ""))), mark, thousands))
    return found


def salary(text: str) -> tuple[int | None, int | None, str | None]:
    """(low, high, currency) of the first range, else of the first amount with a sign; hourly pay made yearly."""
    tokens = _TOKEN.findall(text)
    found = amounts(tokens)
    after = lambda a, codes: tokens[a.last + 1] if a.last + 1 < len(tokens) and tokens[a.last + 1] in codes else None
    for a, b in zip(found, found[1:], strict=False):
        # the second end may have a sign in front, but no code
        begins = b.first if b.mark in SIGNS else b.last - b.thousands
        if begins != a.last + 2 or tokens[a.last + 1].lower() not in BETWEEN:
            continue
        code = after(b, CODES)
        low, high = a.whole(b.thousands), b.whole(a.thousands)
        telling = a.mark or (b.mark in SIGNS) or code or a.thousands or b.thousands
        if not telling and min(low, high) < LEAST:
            return None, None, None
        low, high = yearly(low), yearly(high)
        if believed(low) and believed(high) and low <= high:
            return low, high, code or SIGNS.get(a.mark, a.mark)
        break  # only the first range counts
    for a in found:
        if a.mark in SIGNS:
            value = yearly(a.whole())
            plus = a.last + 1 < len(tokens) and tokens[a.last + 1] == "+"
            code = after(Amount(a.first, a.last + plus, a.value, a.mark, a.thousands), SIGNED_CODES)
            return (value, None, code or SIGNS[a.mark]) if believed(value) else (None, None, None)
    return None, None, None


def with_salary(rows: DataFrame, text: str, low: str = "salary_min", high: str = "salary_max", currency: str = "salary_currency") -> DataFrame:
    """The rows with the first plausible yearly amount or range of the text."""

    @F.pandas_udf(f"{low} long, {high} long, {currency} string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        found = [salary(x) if isinstance(x, str) else (None, None, None) for x in texts]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pd.DataFrame({low: pd.array(columns[0], "Int64"), high: pd.array(columns[1], "Int64"), currency: pd.Series(columns[2], dtype=object)})

    kept = [x for x in rows.columns if x not in (low, high, currency)]
    return rows.select(*kept, parsed(text).alias("__pay")).select(*kept, f"__pay.{low}", f"__pay.{high}", f"__pay.{currency}")
