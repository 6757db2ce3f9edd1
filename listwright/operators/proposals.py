"""New companies that found postings name: relevant postings, of companies not known yet, summed up and ranked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_description
from ..sources.tables import dealt
from ..sources.work import work_dir
from .keywords import Taxonomy, classify
from .normalize import fenced
from .reports import candidates, rank_candidates
from .resolve import match_names, normalize_name
from .scoring import Lexicon, with_relevance, with_role_text

SAMPLES = {"title": 3, "location": 3}


#: what the relevance of a found posting comes from
TEXTS = ("title", "description")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared work folder: worked out once, and joined by broadcast while it is small."""
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def relevant_texts(texts: DataFrame, lexicon: Lexicon, taxonomy: Taxonomy, scope: str = "all") -> DataFrame:
    """The distinct ones of the texts (title, description) that are relevant by the model under the scope, as a table."""
    once = texts.select(*TEXTS).distinct().withColumn("audio_scope", F.lit(scope)).withColumn("company_category", F.lit(None).cast("string"))
    plain = fenced(dealt(once, *TEXTS).withColumn("__plain", clean_description(F.col("description"))))
    rows = fenced(classify(fenced(with_role_text(plain, "description", clean="__plain")), taxonomy, name="categories"))
    return _stored(with_relevance(rows, lexicon, clean="__plain").where("is_audio_related").select(*TEXTS), "relevant-texts")


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows whose title and description are among the texts; nulls equal nulls."""
    among = texts.select(*[F.col(x).alias(f"__{x}") for x in TEXTS])
    return rows.join(among, reduce(and_, [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in TEXTS]), "left_semi")


def new_companies(found: DataFrame, known: DataFrame, lexicon: Lexicon, taxonomy: Taxonomy, blocked: Sequence[str] = (), least: int = 1, scope: str = "all", limit: int | None = None) -> DataFrame:
    """Candidates from found postings (place, company_name, title, description, location, search_term, country, company_url), the most named first.

    A posting counts if it is relevant by the model under the given scope; a company if none of the known names (name)
    is its own by any stage of name matching, and its name has none of the blocked words. Postings are found many times,
    by other terms and of other companies: each distinct text goes through the model once.
    """
    return of_relevant(with_texts(found, relevant_texts(found, lexicon, taxonomy, scope)), known, blocked, least, limit)


def of_relevant(found: DataFrame, known: DataFrame, blocked: Sequence[str] = (), least: int = 1, limit: int | None = None) -> DataFrame:
    """As `new_companies`, from found postings that are all relevant: where texts are a table of their own, they are chosen before who found them is joined."""
    c = F.col
    named = found.where(F.length(F.trim("company_name")) > 0)
    if blocked:
        named = named.where(~F.arrays_overlap(F.split(F.lower("company_name"), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(b.lower()) for b in blocked])))
    named = _stored(named, "proposals")
    # a table, too: the matching reads the names many times, and would normalise them row by row below the distinct
    names = _stored(named.select(c("company_name").alias("name")).distinct(), "names")
    # the names are distinct, and so the rows keep their number
    free = match_names(names, known).where("matched is null").select(c("name").alias("company_name"), normalize_name(c("name")).alias("__name"))
    return rank_candidates(candidates(named.join(_stored(free, "free-names"), "company_name"), "place", samples=SAMPLES, key="__name"), least, limit)
