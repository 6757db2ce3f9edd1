"""Categories and relevance of postings, by explainable rules over a keyword lexicon given as a parameter."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import subset
from ..functions.text import beginning, clean_description

#: fixed values: where the description of the role begins, and where the company's own text begins after it
ROLE_MARKERS = (
    "what you'll do", "what you will do", "responsibilities", "about the role", "the role", "your role", "in this role",
    "requirements", "qualifications", "what we're looking for", "your impact", "key qualifications",
    "minimum qualifications", "who you are", "the opportunity", "job description", "duties",
)
CLOSING_MARKERS = (
    "who we are", "about us", "about the company", "equal opportunity employer", "we are an equal",
    "equal employment opportunit", "eeo", "benefits include", "our benefits", "compensation and benefits",
    "privacy policy",
)
EEO = "equal employment opportunit"
LEAST_CATEGORY_SCORE, MOST_CATEGORIES = 5, 3
#: characters of the role text that categories and relevance look at; None as a limit is the whole text
CATEGORY_TEXT, RELEVANCE_TEXT = 6000, 8000
THRESHOLDS = {"native": 45, "partial": 50, "all": 55}


@dataclass(frozen=True)
class Lexicon:
    """Keywords by category and tier, and the patterns of the relevance score."""

    strong: Mapping[str, Sequence[str]]
    weak: Mapping[str, Sequence[str]]
    title_only: Sequence[str] = ()
    label_only: Sequence[str] = ()
    dominance: Mapping[str, Sequence[str]] = field(default_factory=dict)
    title_strong: str = r"(?!)"
    title_weak: str = r"(?!)"
    text_strong: str = r"(?!)"
    text_weak: str = r"(?!)"
    requirement: str = r"(?!)"
    negative: str = r"(?!)"
    corporate: str = r"(?!)"
    veto: str = r"(?!)"


def keyword_pattern(words: Sequence[str]) -> str:
    """Whole words or phrases, plural or not, the longest first."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    escaped = [re.sub(r"([^\w\s])", r"\\\1", w) for w in ordered]
    return r"(?U)(?<!\w)(?:" + "|".join(escaped) + r")(?:s|es)?(?!\w)"


def _first(text: Column, marks: Sequence[str], start: Column, end: Column) -> Column:
    """0-based place of the earliest mark that lies from start to end; end if none does."""
    places = F.array(*[F.instr(F.substr(text, start + 1), F.lit(m)) for m in marks])
    ends = F.array(*[F.lit(len(m)) for m in marks])
    both = F.filter(F.zip_with(places, ends, lambda p, n: F.when((p > 0) & (start + p - 1 + n <= end), start + p - 1)), lambda x: x.isNotNull())
    return F.coalesce(F.array_min(both), end)


def with_role_text(rows: DataFrame, description: str, name: str = "role_text", clean: str | None = None) -> DataFrame:
    """The part of the description that tells of the role; the whole cleaned text where that would be under 200 characters. clean: a column with the cleaned description, if the rows have it."""
    c = F.col
    staged = rows.withColumn("__clean", F.coalesce(c(clean) if clean else clean_description(c(description)), F.lit("")))
    staged = staged.withColumn("__low", F.lower(F.translate("__clean", "’‘", "''")))
    n = F.length("__clean")
    staged = staged.withColumns({"__cut": _first(c("__low"), CLOSING_MARKERS, F.floor(n * 0.6).cast("int"), n), "__eeo": _first(c("__low"), (EEO,), F.floor(n * 0.3).cast("int"), n)})
    end = F.least("__cut", "__eeo")
    gap = F.instr(c("__clean"), F.lit("\n\n"))
    staged = staged.withColumn("__from", _first(c("__low"), ROLE_MARKERS, F.lit(0), end))
    none = c("__from") >= end
    skip = F.least(F.when(gap > 0, gap - 1).otherwise(n), F.lit(600))
    staged = staged.withColumn("__role", F.when(none, F.ltrim(F.substr(c("__clean"), skip + 1))).otherwise(F.substr(c("__clean"), c("__from") + 1)))
    m = F.length("__role")
    cut = _first(F.lower("__role"), CLOSING_MARKERS, F.floor(m * 0.6).cast("int"), m)
    staged = staged.withColumn("__role", F.rtrim(F.substr(c("__role"), F.lit(1), cut)))
    kept = [x for x in rows.columns if x != name]
    return staged.select(*kept, F.when(F.length("__role") < 200, c("__clean")).otherwise(c("__role")).alias(name))


def _hits(text: Column, words: Sequence[str]) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(keyword_pattern(words)), 0))) if words else F.lit(0)


def _without_dominated(dominant: str, below: Sequence[str]) -> Column:
    """The scored categories; where the title names the dominant one, those below it that the title does not name go."""
    rules = F.exists("__scored", lambda x: (x["category"] == dominant) & (x["untitled"] == 0))
    kept = F.filter("__scored", lambda x: ~(x["category"].isin(*below) & (x["untitled"] == 1)))
    return F.when(rules, kept).otherwise(F.col("__scored"))


def with_categories(rows: DataFrame, lexicon: Lexicon, title: str = "title", role: str = "role_text", name: str = "categories", text_limit: int | None = CATEGORY_TEXT) -> DataFrame:
    """The rows with up to three categories, sorted by name; the best by score, then title hit, then name.

    A title scores 6 for a strong and 3 for a weak keyword of a category, the role text 3 and one more for each further
    distinct strong keyword up to 5, and up to 2 for weak ones; 5 are needed.
    """
    t, r = F.lower(F.col(title)), F.lower(beginning(F.col(role), text_limit))
    structs = []
    for category in sorted({*lexicon.strong, *lexicon.weak}):
        strong, weak = lexicon.strong.get(category, ()), lexicon.weak.get(category, ())
        in_strong = t.rlike(keyword_pattern(strong)) if strong else F.lit(False)
        in_weak = t.rlike(keyword_pattern(weak)) if weak else F.lit(False)
        score = F.when(in_strong, 6).otherwise(0) + F.when(in_weak, 3).otherwise(0)
        if category not in lexicon.title_only:
            n, m = _hits(r, strong), _hits(r, weak)
            score = score + F.when(n > 0, F.least(n + 2, F.lit(5))).otherwise(0) + F.least(m, F.lit(2))
        structs.append(F.struct((-score).alias("order"), F.when(in_strong | in_weak, 0).otherwise(1).alias("untitled"), F.lit(category).alias("category")))
    scored = F.filter(F.array(*structs), lambda x: x["order"] <= -LEAST_CATEGORY_SCORE)
    staged = rows.withColumn("__scored", scored)
    for dominant, below in lexicon.dominance.items():
        staged = staged.withColumn("__scored", _without_dominated(dominant, below))
    best = F.transform(F.slice(F.array_sort("__scored"), 1, MOST_CATEGORIES), lambda x: x["category"])
    return staged.withColumn(name, F.array_sort(best)).drop("__scored")


def with_relevance(rows: DataFrame, lexicon: Lexicon, title: str = "title", description: str = "description", role: str = "role_text", categories: str = "categories", scope: str = "audio_scope", score: str = "relevance_score", flag: str = "is_audio_related", text_limit: int | None = RELEVANCE_TEXT, clean: str | None = None) -> DataFrame:
    """The rows with their relevance score and whether it reaches the threshold of their company's scope. clean: as of `with_role_text`."""
    c = F.col
    t, low = c(title), F.lower(beginning(c(role), text_limit))
    strong, weak = t.rlike(lexicon.title_strong), t.rlike(lexicon.title_weak)
    labels = F.array(*[F.lit(x) for x in lexicon.label_only]).cast("array<string>")
    domain = ~subset(F.coalesce(c(categories), F.array().cast("array<string>")), labels)
    s, w = F.regexp_count(low, F.lit(lexicon.text_strong)), F.regexp_count(low, F.lit(lexicon.text_weak))
    native = F.coalesce(c(scope) == "native", F.lit(False))
    raw = F.when(strong, 60).when(weak, 30).otherwise(0) + F.when(s >= 3, 35).when(s >= 1, 20).when(w >= 3, 15).otherwise(0)
    raw = raw + F.when(F.coalesce(c(role).rlike(lexicon.requirement), F.lit(False)), 45).otherwise(0) + F.when(domain & native, 35).when(domain, 25).otherwise(0)
    staged = rows.withColumns({"__raw": F.coalesce(raw, F.lit(0)), "__native": native, "__strong": F.coalesce(strong, F.lit(False)), "__weak": F.coalesce(weak, F.lit(False))})
    text = F.lower(F.concat_ws("\n", t, c(clean) if clean else clean_description(c(description))))
    full = c("__raw") + F.when(c("__native") & (c("__raw") > 0), 10).otherwise(0) - F.when(text.rlike(lexicon.negative), 45).otherwise(0)
    full = full - F.when(F.coalesce(t.rlike(lexicon.corporate), F.lit(False)) & ~c("__strong"), 70).otherwise(0)
    staged = staged.withColumn("__score", F.when(F.coalesce(t.rlike(lexicon.veto), F.lit(False)), 0).otherwise(F.greatest(full, F.lit(0))))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), c(scope)), F.lit(55))
    limit = limit + F.when(~c("__strong") & ~c("__weak") & ~c("__native"), 15).otherwise(0)
    kept = [x for x in rows.columns if x not in (score, flag)]
    return staged.select(*kept, c("__score").alias(score), ((c("__score") > 0) & (c("__score") >= limit)).alias(flag))
