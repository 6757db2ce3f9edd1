"""Scores that are worked out again only where something has changed.

Each stored score carries a mark: a hash of everything that it came from, the row's inputs and the model's own values.
Rows with the mark that they would get now keep their scores; the others, and new ones, go through the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_description
from .keywords import Taxonomy, classify
from .lifecycle import effective
from .normalize import fenced
from .scoring import Lexicon, with_relevance, with_role_text

#: what a score comes from, of the row and of its company
INPUTS = ("title", "description", "audio_scope", "company_category", "categories_override", "is_audio_related_override")
SCORES = ("job_categories", "relevance_score", "is_audio_related")


def mark(lexicon: Lexicon, taxonomy: Taxonomy) -> Column:
    """128 bits of the inputs and the model; nulls are told from blanks."""
    parts = [F.lit(repr(lexicon)), F.lit(repr(taxonomy))]
    for x in INPUTS:
        parts += [F.col(x).isNull(), F.col(x)]
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))


def score(rows: DataFrame, lexicon: Lexicon, taxonomy: Taxonomy) -> DataFrame:
    """The rows with SCORES by the whole model; overrides win."""
    kept = [c for c in rows.columns if c not in SCORES]
    staged = fenced(with_role_text(fenced(rows.select(*kept).withColumn("__plain", clean_description(F.col("description")))), "description", clean="__plain"))
    staged = fenced(classify(staged, taxonomy, name="__found"))
    staged = staged.withColumn("job_categories", F.coalesce("categories_override", "__found")).drop("__found")
    scored = with_relevance(fenced(staged), lexicon, categories="job_categories", clean="__plain").drop("role_text", "__plain")
    return scored.withColumn("is_audio_related", effective(F.col("is_audio_related_override"), F.col("is_audio_related")))


def rescored(jobs: DataFrame, companies: DataFrame, lexicon: Lexicon, taxonomy: Taxonomy, stored: DataFrame | None = None, company: str = "company_id") -> DataFrame:
    """(id, SCORES, mark, skipped) of every row that has a company. stored: an earlier result; without one all rows are scored."""
    of = companies.select(F.col("id").alias(company), "audio_scope", F.col("category").alias("company_category"))
    rows = jobs.drop("audio_scope", "company_category").join(of, company).select("id", *INPUTS).withColumn("mark", mark(lexicon, taxonomy))
    if stored is None:
        return score(rows, lexicon, taxonomy).select("id", *SCORES, "mark", F.lit(False).alias("skipped"))
    known = stored.select("id", "mark", *SCORES)
    same = rows.select("id", "mark").join(known, ["id", "mark"]).select("id", *SCORES, "mark", F.lit(True).alias("skipped"))
    other = rows.join(known.select("id", "mark"), ["id", "mark"], "left_anti")
    return same.unionByName(score(other, lexicon, taxonomy).select("id", *SCORES, "mark", F.lit(False).alias("skipped")))
