"""Queries of pages, keywords and the category model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, keywords
from ..sources.tables import table
from .queries import query

c = F.col


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
 '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_main_texts(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page."""
    return extract.main_texts(table(spark, d, "pages"))


#: judging words for the tables' pages, whose links are words of invented languages
WORDS = extract.LinkWords(hints=("th", "qu", "sch"), lists=("that", "que", "und"), labels=("the", "le", "la", "der", "los"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">[^<]*</a>')) AS a FROM pages),
l AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '>([^<]*)<', 1), '\s+', ' ', 'g')) AS text FROM a),
t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link, text, trim(text, ' -–—|,;:/') AS title, lower(href) AS path FROM l),
v AS (SELECT *, regexp_matches(path, 'th|qu|sch') AND split_part(path, '/', -1) NOT IN ('that', 'que', 'und') AND path <> '/' OR regexp_matches(lower(text), 'th|qu|sch') AS hint FROM t)
SELECT page_id, link, title, CASE WHEN lower(title) IN ('the', 'le', 'la', 'der', 'los') THEN 'label' WHEN length(title) < 3 THEN 'length' WHEN NOT hint THEN 'hint' ELSE 'posting' END AS verdict FROM v""")
def page_link_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every page, and whether it is a posting or which rule it fails."""
    return extract.judged_links(table(spark, d, "pages"), words=WORDS).select("page_id", "link", "title", "verdict")


#: keywords of the documents' languages, by tier
LANGUAGES = keywords.Taxonomy(
    {"de": ("der", "und", "sch"), "en": ("the", "and", "thing"), "es": ("los", "que"), "fr": ("le", "la", "des")},
    {"de": ("mit", "auf"), "en": ("with", "from", "this"), "es": ("por", "con"), "fr": ("dans", "pour", "une")},
)
_CASES = ", ".join(f"('{category}', '{tier}', [{', '.join(repr(w) for w in words)}])" for tier, by in (("strong", LANGUAGES.strong), ("weak", LANGUAGES.weak)) for category, words in by.items())


@query(rf"""WITH k(category, tier, words) AS (VALUES {_CASES}), d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pM\p{{Nd}}\p{{Nl}}\p{{Pc}}]+') AS w FROM documents),
h AS (SELECT doc_id, category, tier, list_sort(list_distinct(list_filter(w, lambda x: list_contains(words, x) OR list_contains(words, regexp_replace(x, 's$', '')) OR list_contains(words, regexp_replace(x, 'es$', ''))))) AS hits FROM d, k)
SELECT doc_id, category, tier, len(hits) AS n, array_to_string(hits, ',') AS hits FROM h WHERE len(hits) > 0""")
def keyword_evidence(spark: SparkSession, d: str) -> DataFrame:
    """By document, category and tier, the distinct keywords of its whole text."""
    found = keywords.evidence(table(spark, d, "documents"), LANGUAGES, ["doc_id"], "text")
    return found.select("doc_id", "category", "tier", F.size("hits").cast("long").alias("n"), F.array_join("hits", ",").alias("hits"))
