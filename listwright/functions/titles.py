"""Titles of postings: noise, roles, exclusions, cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ROLE_NOUN, normalize_title, squeeze, title_class

#: words of pages around a list of postings, how many words such labels have, and phrases that lead to a list
LIST_ENDINGS = ("jobs", "careers", "career", "vacancies", "openings", "opportunities", "positions")
LABEL_LEADS = ("explore", "browse", "see", "view", "show", "find", "discover", "search", "start")
SAVED_WORDS = ("saved", "favourite", "favourites", "favorite", "favorites", "recommended", "recently viewed", "job alert", "job alerts")
MOST_LIST_WORDS, MOST_LABEL_WORDS, MOST_TITLE_WORDS = 5, 6, 12
POINTERS = tuple(f"{verb} all {thing}" for verb in ("view", "see", "browse", "search") for thing in ("job", "opening")) + ("view open positions", "see open positions", "view open roles")
FURNITURE = ("sign in", "log in", "privacy policy", "terms of use", "cookie", "subscribe", "newsletter", "skip to", "read more", "learn more", "contact us")
#: nouns of roles in other languages, beside the English ones
ROLES_ELSEWHERE = ("ingenieur", "ingénieur", "ingeniero", "entwickler", "développeur", "techniker", "technicien", "leiter", "berater", "mitarbeiter", "verkäufer", "responsable", "chargé", "stagiaire", "praktikant", "werkstudent")


def _words(title: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != ""))


def has_role_noun(title: Column) -> Column:
    return F.coalesce(title.rlike(ROLE_NOUN), F.lit(False))


def looks_like_role(title: Column) -> Column:
    """Whether a title names a role, in English or one of the languages around."""
    return has_role_noun(title) | F.coalesce(title.rlike(rf"(?iU)(?:{'|'.join(ROLES_ELSEWHERE)})"), F.lit(False))


def is_listing_title(title: Column) -> Column:
    """Labels of lists (`Engineering jobs`), of buttons (`Browse roles`) and of saved searches; never with a role's noun."""
    low, n = F.lower(F.trim(title)), _words(title)
    ends = (n > 1) & (n <= MOST_LIST_WORDS) & F.element_at(F.split(low, r"\s+"), -1).isin(*LIST_ENDINGS)
    leads = (n <= MOST_LABEL_WORDS) & F.split(low, r"[^\w]+")[0].isin(*LABEL_LEADS)
    saved = (n <= MOST_LABEL_WORDS) & low.rlike(rf"\b(?:{'|'.join(SAVED_WORDS)})\b")
    return ~has_role_noun(title) & (ends | leads | saved)


def is_pointer(text: Column) -> Column:
    """Whether a text points to a list of postings."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in POINTERS]), lambda p: F.contains(low, p))


def is_furniture(title: Column) -> Column:
    """Titles that are parts of a page: long or broken sentences, counts, page numbers, notices."""
    raw = F.trim(title)
    low = F.lower(raw)
    phrases = F.exists(F.array(*[F.lit(p) for p in FURNITURE]), lambda p: F.contains(low, p))
    control = low.rlike(r"^[«‹<]*\s*(?:next|prev|previous|first|last|page \d{1,4}|\d{1,4})\s*[»›>]*$")
    return (_words(title) > MOST_TITLE_WORDS) | raw.rlike(r"[.!?] \p{Lu}") | raw.rlike(r"(?:\.\.\.|…)$") | low.rlike(r"\b\d+ (?:open )?(?:jobs|positions|openings|results)\b") | phrases | control


def is_region_title(title: Column, countries: Sequence[str]) -> Column:
    """A country's name, alone or with `jobs` or `careers`."""
    name = F.trim(F.regexp_replace(normalize_title(title), r"\s+(?:jobs|careers)$", ""))
    return name.isin(*[c.lower() for c in countries])


def is_taxonomy_title(title: Column, countries: Sequence[str] = ()) -> Column:
    """Rows of a list of places or departments rather than postings."""
    kind = title_class(title)
    return kind.isin("navigation", "boilerplate") | (is_region_title(title, countries) if countries else F.lit(False))


# ---- exclusions ----


def is_clinical(title: Column, clinical: str, exempt: str) -> Column:
    """A clinical title, unless it is one of technical work as well."""
    return F.coalesce(title.rlike(clinical) & ~title.rlike(exempt), F.lit(False))


def is_shift_work(title: Column, word: str, signals: Sequence[str]) -> Column:
    """An abbreviation in a title of shift work, where nothing else in the title speaks for the domain."""
    shift = title.rlike(r"(?i)\b(?:1st|2nd|3rd|first|second|third|night|weekend)\s+shift\b")
    rest, other = F.regexp_replace(title, word, " "), F.lit(False)
    for pattern in signals:
        other = other | rest.rlike(pattern)
    return F.coalesce(shift & title.rlike(word) & ~other, F.lit(False))


def is_named_role(title: Column, category: Column, categories: Sequence[str], words: str) -> Column:
    """A title with one of the words, at a company of one of the categories."""
    return F.coalesce(category.isin(*categories) & title.rlike(words), F.lit(False))


def scope_of(category: Column, partial: Sequence[str], agencies: Sequence[str]) -> Column:
    """all for agencies, partial for the listed categories, native for others."""
    return F.when(category.isin(*agencies), "all").when(category.isin(*partial), "partial").otherwise("native")


# ---- cleaning ----

EMPLOYMENT = r"full[- ]?time|part[- ]?time|contract(?:or)?|temporary|internship|permanent|freelance"
#: rewritings of a title, tried in order until one fires, over and over: (name, pattern, replacement)
REWRITES = (
    ("file", re.compile(r"\s*[(\[]\s*(?:pdf|docx?)[^)\]]*[)\]]\s*$", re.I)),
    ("call", re.compile(r"^(?:apply(?: now)?(?: for)?|view job|read more(?: about)?|learn more(?: about)?)\s*[:–—-]?\s+", re.I)),
    ("arrow", re.compile(r"\s*[→➔»›>]+\s*$")),
    ("posted", re.compile(r"\s*[|(–—-]?\s*posted\s+(?:\d+\+?\s+\w+\s+ago|today|yesterday)\)?\s*$", re.I)),
    ("call", re.compile(r"\s*[|–—-]?\s*(?:apply(?: now)?|read more|learn more|view job|details)\s*$", re.I)),
    ("employment", re.compile(rf"\s*[|,(–—-]\s*({EMPLOYMENT})\s*\)?\s*$", re.I)),
    ("place", re.compile(r"\s+[|–—-]\s+remote(?:\s*[,(/–—-].*)?$", re.I)),
    ("remote", re.compile(r"\s*\(remote\)\s*$", re.I)),
    ("state", re.compile(r",\s*[A-Z]{2}$")),
    ("stop", re.compile(r"\s+(?:in|at|for|and|or|of|the|-)$", re.I)),
)
EDGE_MARKS = " \t-–—|,;:/"
ACRONYMS = frozenset({"AI", "API", "AV", "CAD", "CEO", "CFO", "CTO", "DSP", "ERP", "FOH", "HR", "IT", "ML", "NVH", "PCB", "QA", "RF", "SEO", "UI", "UX", "VP", "VR", "MIDI", "VST"})
ROUNDS = 8


def tidy_title(text: str | None) -> tuple[str, str | None]:
    """(title, employment type it ended with): rewritings to a fixpoint, then the case of shouted titles."""
    title, kind = " ".join((text or "").split()), None
    for _ in range(ROUNDS):
        before = title
        for name, pattern in REWRITES:
            m = pattern.search(title)
            if m:
                kind = m[1] if name == "employment" else kind
                title = title[: m.start()] + title[m.end() :]
                break
        title = " ".join(title.split()).strip(EDGE_MARKS)
        if title == before:
            break
    return _calm(title), kind


def _calm(title: str) -> str:
    """Title case for titles of five words and more that are all in capitals or have none; acronyms stay."""
    words = title.split(" ")
    if len(words) < 5 or not (title.isupper() or title.islower()):
        return title

    def one(word: str) -> str:
        core = word.strip("()[],.;:/&")
        return word.replace(core, core.upper() if core.upper() in ACRONYMS else "-".join(p.capitalize() for p in core.split("-"))) if core else word

    return " ".join(map(one, words))


def clean_title(title: Column) -> Column:
    """{title, job_type} of a link's text."""

    @F.pandas_udf("title string, job_type string")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(texts.map(tidy_title).tolist(), columns=["title", "job_type"])

    return cleaned(title)


def page_ids(title: Column) -> Column:
    """The slug that names a posting on a page of several."""
    return F.btrim(F.regexp_replace(F.lower(squeeze(title)), r"[^a-z0-9]+", "-"), F.lit("-"))


