"""Countries of free-text locations, from a lexicon table."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import beginning

#: places are looked up in the first MAX_LENGTH characters of a location (None: all), by runs of MAX_WORDS words at most
MAX_LENGTH, MAX_WORDS = 300, 3
#: kinds of lexicon rows in order of precedence; of the first three only a single country counts
KINDS = ("name", "state", "city", "state_code", "province", "code")


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one plain letter and marks."""
    source, target = [], []
    for i in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            source.append(chr(i))
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents; marks become blanks."""
    source, target = _plain_letters()
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, source, target)), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def segments(location: Column, max_length: int | None = MAX_LENGTH) -> Column:
    parts = F.split(F.regexp_replace(beginning(location, max_length), r"[()]", ","), r"[,;|/:\n]|\s[-–—]\s")
    return F.filter(F.transform(parts, fold), lambda s: s != "")


def phrases(parts: Column) -> Column:
    """The segments and their runs of one to three words, distinct."""

    def runs(segment: Column) -> Column:
        words = F.split(segment, " ")

        def of(n: int) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i <= F.size(words) - n + 1)
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

        return F.concat(F.array(segment), *[of(n) for n in range(1, MAX_WORDS + 1)])

    return F.array_distinct(F.flatten(F.transform(parts, runs)))


def detect_country(rows: DataFrame, location: str, lexicon: DataFrame, name: str = "country", max_length: int | None = MAX_LENGTH) -> DataFrame:
    """The rows with the country of their location, null if unknown or contradictory.

    lexicon: (kind, phrase, country) with folded phrases; codes and state codes count as whole segments only. Each
    distinct location is looked up once: its phrases are joined with the lexicon, which Catalyst broadcasts while small.
    """
    places = rows.where(F.trim(F.col(location)) != "").select(F.col(location).alias("__place")).distinct()
    parts = places.select("__place", segments(F.col("__place"), max_length).alias("__parts"))
    found = parts.select("__place", "__parts", F.explode(phrases(F.col("__parts"))).alias("phrase")).join(lexicon, "phrase")
    found = found.where(~F.col("kind").isin("state_code", "code") | F.array_contains("__parts", F.col("phrase")))
    votes = found.groupBy("__place").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("country"))).alias(f"__{k}") for k in KINDS])

    def sole(kind: str) -> Column:
        return F.when(F.size(f"__{kind}") == 1, F.element_at(f"__{kind}", 1))

    answer = F.when(F.size("__name") > 0, sole("name"))
    answer = answer.when(F.size("__state") > 0, sole("state")).when(F.size("__city") > 0, sole("city"))
    answer = answer.when(F.size("__state_code") > 0, sole("state_code")).when(F.size("__province") > 0, sole("province")).otherwise(sole("code"))
    known = votes.select("__place", answer.alias("__country"))
    kept = [F.col(x) for x in rows.columns if x != name]
    return rows.join(known, rows[location] == known["__place"], "left").select(*kept, F.col("__country").alias(name))


def country_name(code: Column, names: dict[str, str]) -> Column:
    """The display name of a code; null if the code is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.upper(code))
