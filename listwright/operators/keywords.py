"""Categories of postings by one keyword automaton over a whole taxonomy, with the rules that override plain scores.

All keywords of all categories and tiers are one Aho-Corasick machine, built once a Python worker and run once over each
text of an Arrow batch, whatever the number of categories. A keyword counts as a whole word or phrase, plural or not;
where keywords of one category and tier overlap, the one that begins first counts, of those the longest. A taxonomy is
data: it comes from a file, and so do its rules.

Defined cases: null texts count as empty and have no evidence; no category without keywords is ever found; equal scores
go by title hit, then by name; a taxonomy without categories gives empty lists.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG, WEAK, ANCHOR = "strong", "weak", "anchor"
TITLE_STRONG, TITLE_WEAK, LEAST_SCORE, MOST = 6, 3, 5, 3
#: characters around a keyword of an anchored category in which an anchor must stand
WINDOW = 200


@dataclass(frozen=True)
class Rule:
    """What overrides scores; kind says how the other fields are meant.

    replaces: a title that matches takes `gone` away; if any was there, or nothing was but an anchor, `category` is given.
    raises: where anything was found, a title that matches gives `category`.
    joins: a title of a company among `companies` that matches takes `category` in besides the best two.
    yields: `category` goes where one of `gone` is found, unless the title names it strongly.
    takes: companies among `companies`: a title that matches, and doesn't match `unless`, or matches `also` where anything
    was found, has the best two without `gone`, and `category`; not where `spared` is found.
    last: a title that matches `unless` stays without category; one that matches has `category`, where nothing was found.
    """

    kind: str
    category: str
    title: str = r"(?!)"
    gone: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    unless: str = r"(?!)"
    also: str = r"(?!)"
    spared: str = ""


@dataclass(frozen=True)
class Taxonomy:
    strong: Mapping[str, Sequence[str]]
    weak: Mapping[str, Sequence[str]] = field(default_factory=dict)
    anchors: Sequence[str] = ()
    anchored: frozenset[str] = frozenset()
    title_only: frozenset[str] = frozenset()
    dominance: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()

    @property
    def categories(self) -> list[str]:
        return sorted({*self.strong, *self.weak})


def load_taxonomy(path: str) -> Taxonomy:
    """A taxonomy from JSON: categories (id, strong, weak, anchored, title_only, dominates), anchors and rules."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rows = spec["categories"]
    if len({r["id"] for r in rows}) < len(rows):
        raise ValueError("a category is there twice")
    known = {r["id"] for r in rows}
    rules = tuple(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in spec.get("rules", ()))
    named = {x for r in rules for x in (r.category, *r.gone)} | {x for r in rows for x in r.get("dominates", ())}
    if named - known:
        raise ValueError(f"unknown categories: {', '.join(sorted(named - known))}")
    return Taxonomy(
        {r["id"]: r.get("strong", ()) for r in rows}, {r["id"]: r.get("weak", ()) for r in rows}, spec.get("anchors", ()),
        frozenset(r["id"] for r in rows if r.get("anchored")), frozenset(r["id"] for r in rows if r.get("title_only")),
        {r["id"]: tuple(r["dominates"]) for r in rows if r.get("dominates")}, rules,
    )


@lru_cache(1 << 16)
def _in_word(c: str) -> bool:
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc") or c in "\u200c\u200d"


class Machine:
    """All keywords at once; an owner is a (category, tier) that a keyword belongs to."""

    def __init__(self, keywords: Iterable[tuple[tuple[str, str], str]]):
        owners: dict[str, list[tuple[str, str]]] = {}
        for owner, word in keywords:
            if word:
                owners.setdefault(word.lower(), []).append(owner)
        self.machine = ahocorasick.Automaton()
        for word, own in owners.items():
            self.machine.add_word(word, (len(word), tuple(dict.fromkeys(own))))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def spans(self, text: str) -> dict[tuple[str, str], list[tuple[int, int]]]:
        """The places of each owner's keywords in a lower-cased text, in order and apart from one another."""
        found: dict[tuple[str, str], list[tuple[int, int]]] = {}
        if self.empty:
            return found
        n = len(text)
        for last, (size, owners) in self.machine.iter(text):
            start, end = last - size + 1, last + 1
            if start and _in_word(text[start - 1]):
                continue
            for ending in ("s", "es", ""):
                stop = end + len(ending)
                if text.startswith(ending, end) and (stop >= n or not _in_word(text[stop])):
                    for owner in owners:
                        found.setdefault(owner, []).append((start, stop))
                    break
        for owner, places in found.items():
            places.sort(key=lambda x: (x[0], -x[1]))
            kept, at = [], 0
            for start, stop in places:
                if start >= at:
                    kept.append((start, stop))
                    at = stop
            found[owner] = kept
        return found


def machine(taxonomy: Taxonomy) -> Machine:
    tiers = ((STRONG, taxonomy.strong), (WEAK, taxonomy.weak), (ANCHOR, {"": taxonomy.anchors}))
    return Machine(((category, tier), word) for tier, by in tiers for category, words in by.items() for word in words)


def hits(text: str, places: Sequence[tuple[int, int]], anchors: Sequence[tuple[int, int]] | None = None) -> set[str]:
    """The distinct keywords at the places; with anchors only those that have one within WINDOW."""
    if anchors is None:
        return {text[a:b] for a, b in places}
    return {text[a:b] for a, b in places if any(x >= a - WINDOW and y <= b + WINDOW for x, y in anchors)}


class Classifier:
    """The categories of one posting after another."""

    def __init__(self, taxonomy: Taxonomy):
        self.taxonomy, self.machine = taxonomy, machine(taxonomy)
        self.patterns = [{k: re.compile(getattr(r, k), re.IGNORECASE) for k in ("title", "unless", "also")} for r in taxonomy.rules]

    def scores(self, title: str, role: str) -> tuple[dict[str, int], dict[str, bool], set[str], bool]:
        """Scores of the categories that have enough, whether the title names them, those it names strongly, and whether it has an anchor."""
        t = self.taxonomy
        in_title, in_role = self.machine.spans(title), self.machine.spans(role)
        anchor = bool(in_title.get(("", ANCHOR)))
        anchors = in_role.get(("", ANCHOR), [])
        scored, titled, strongly = {}, {}, set()
        for category in {c for c, tier in (*in_title, *in_role) if tier != ANCHOR}:
            anchored = category in t.anchored
            strong, weak = bool(in_title.get((category, STRONG))), bool(in_title.get((category, WEAK)))
            score = TITLE_STRONG * strong + weak * (TITLE_STRONG if anchored and anchor else TITLE_WEAK)
            if category not in t.title_only:
                n, m = (len(hits(role, in_role.get((category, tier), ()), anchors if anchored else None)) for tier in (STRONG, WEAK))
                score += min(2 + n, 5) * (n > 0) + min(m, 2)
            if strong:
                strongly.add(category)
            if score >= LEAST_SCORE:
                scored[category], titled[category] = score, strong or weak
        return scored, titled, strongly, anchor

    def __call__(self, title: str | None, role: str | None, company: str | None) -> list[str]:
        title, role = title or "", (role or "").lower()
        scored, titled, strongly, anchor = self.scores(title.lower(), role)
        for rule, says in zip(self.taxonomy.rules, self.patterns, strict=True):
            given = False
            if rule.kind == "replaces" and says["title"].search(title):
                taken = [scored.pop(c) for c in rule.gone if c in scored]
                given = bool(taken) or (not scored and anchor)
            elif rule.kind == "raises":
                given = bool(scored) and bool(says["title"].search(title))
            if given:
                scored[rule.category], titled[rule.category] = max(scored.get(rule.category, 0), TITLE_STRONG), True
        for ruling, below in self.taxonomy.dominance.items():
            if ruling in scored and titled.get(ruling):
                for c in below:
                    if c in scored and not titled.get(c):
                        del scored[c]
        ranked = sorted(scored, key=lambda c: (-scored[c], not titled.get(c), c))
        found = sorted(ranked[:MOST])
        for rule, says in zip(self.taxonomy.rules, self.patterns, strict=True):
            matches = bool(says["title"].search(title))
            if rule.kind == "joins" and matches and company in rule.companies and rule.category not in found:
                return sorted([*ranked[: MOST - 1], rule.category])
            if rule.kind == "yields" and rule.category in found and rule.category not in strongly and set(rule.gone) & set(found):
                found = sorted([c for c in ranked if c != rule.category][:MOST])
            if rule.kind == "takes" and company in rule.companies and rule.spared not in found:
                if (matches and not says["unless"].search(title)) or (found and says["also"].search(title)):
                    return sorted({*[c for c in found if c not in rule.gone][: MOST - 1], rule.category})
            if rule.kind == "last" and not found and not says["unless"].search(title) and matches:
                found = [rule.category]
        return found


_HELD: dict[str, object] = {}


def _held(taxonomy: Taxonomy, kind: type):
    """The worker's own, built once for a taxonomy."""
    key = f"{kind.__name__}:{taxonomy!r}"
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = kind(taxonomy)
    return _HELD[key]


def classify(rows: DataFrame, taxonomy: Taxonomy, title: str = "title", role: str = "role_text", company: str | None = "company_category", name: str = "categories") -> DataFrame:
    """The rows with up to MOST categories, sorted by name. A column of that name is replaced."""

    @F.pandas_udf("array<string>")
    def found(titles: pd.Series, roles: pd.Series, companies: pd.Series) -> pd.Series:
        own = _held(taxonomy, Classifier)
        return pd.Series([own(t, r, c) for t, r, c in zip(titles, roles, companies, strict=True)], dtype=object)

    of = F.col(company) if company else F.lit(None).cast("string")
    return rows.withColumn(name, found(F.col(title).cast("string"), F.col(role).cast("string"), of.cast("string")))


def evidence(rows: DataFrame, taxonomy: Taxonomy, keys: list[str], text: str) -> DataFrame:
    """(keys, category, tier, hits, first): by category and tier the distinct keywords of a text, and where the first stands."""
    schema = "array<struct<category: string, tier: string, hits: array<string>, first: int>>"

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.Series:
        own = _held(taxonomy, _Evidence)
        return pd.Series([own(x) for x in texts], dtype=object)

    return rows.select(*keys, F.explode(found(F.col(text).cast("string"))).alias("e")).select(*keys, "e.*")


class _Evidence:
    def __init__(self, taxonomy: Taxonomy):
        self.machine, self.anchored = machine(taxonomy), taxonomy.anchored

    def __call__(self, text: str | None) -> list[dict]:
        low = (text or "").lower()
        spans = self.machine.spans(low)
        anchors = spans.get(("", ANCHOR), [])
        out = []
        for (category, tier), places in sorted(spans.items()):
            if tier != ANCHOR and (words := hits(low, places, anchors if category in self.anchored else None)):
                out.append({"category": category, "tier": tier, "hits": sorted(words), "first": min(a for a, b in places if low[a:b] in words)})
        return out


def words_near(first: Sequence[str], second: Sequence[str], most: int = 40) -> str:
    """A pattern for a word of each list, in either order, with no more than words and light marks between."""
    a, b = ("|".join(map(re.escape, x)) for x in (first, second))
    gap = rf"[\w\s/&,()+-]{{0,{most}}}?"
    return rf"\b(?:{a})\b{gap}\b(?:{b})\b|\b(?:{b})\b{gap}\b(?:{a})\b"


def any_word(words: Sequence[str]) -> str:
    """A pattern for any of the words or beginnings (those that end in *)."""
    return r"\b(?:" + "|".join(re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) + r"\b" for w in words) + ")"


#: fixed values: words of titles that the rules of a taxonomy of sound and audio go by
SOFTWARE = ("software engineer", "software development", "software developer", "software programming", "firmware engineer")
TESTED = ("test", "testing", "qa", "quality", "validation", "verification", "metrology", "calibration", "reliability")
TESTERS = ("engineer", "engineering", "technician", "manager", "specialist", "analyst", "lead", "developer", "scientist", "architect", "director")
GAME_SOUND = ("audio", "sound", "music", "composer", "foley", "dialogue", "voiceover", "voice over", "voice-over", "wwise", "fmod")
#: fixed values: those rules, in their order
AUDIO_RULES = (
    Rule("replaces", "audio_software", any_word(SOFTWARE), gone=("music_production_recording", "music_technology")),
    Rule("raises", "test_measurement_qa", words_near(TESTED, TESTERS)),
    Rule("joins", "game_audio_interactive", any_word(GAME_SOUND), companies=("Gaming, VR & Immersive Audio",)),
    Rule("yields", "audio_systems", gone=("music_production_recording", "live_sound_events", "sound_design", "av_systems_integration")),
    Rule("takes", "acoustics_consulting", any_word(("acoustic*",)), gone=("audio_systems", "transducers"), companies=("Acoustic Consulting & Engineering",), unless=r"\b(?:engineer|signal processing|sonar)", also=any_word(("consult*", "acoustical")), spared="av_systems_integration"),
)
