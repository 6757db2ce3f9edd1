"""From raw postings to listed ones: the whole row pipeline, and the rescoring of stored rows."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import with_domain
from ..functions.country import MAX_LENGTH, detect_country
from ..functions.salary import with_salary
from .lifecycle import effective
from .keywords import Taxonomy, classify
from .scoring import CATEGORY_TEXT, RELEVANCE_TEXT, Lexicon, with_categories, with_relevance, with_role_text

#: characters of a description that may name the type of a job
TYPE_TEXT = 500


def fenced(rows: DataFrame) -> DataFrame:
    """The same rows, with a fence between the plans below and above.

    Derived columns are used many times by the ones derived from them; without a fence Catalyst would write each out in
    full wherever it is used, and planning would take for ever. Rows are counted as they pass, without Python or a shuffle:
    projections are not merged across an observed count.
    """
    return rows.observe(f"fence-{uuid4().hex}", F.count(F.lit(1)).alias("n"))


def normalize(raw: DataFrame, lexicon: Lexicon, valid: Sequence[str], places: DataFrame | None = None, domains: dict[str, str] | None = None, taxonomy: Taxonomy | None = None, whole_texts: bool = False) -> DataFrame:
    """Raw postings (title, url, description, location, job_type, posted_date, remote_hint, audio_scope, company_category, company_name) with all that is derived.

    Pay is read from the title and description as they came; categories are those of the cleaned title, kept if valid, and
    scored before the company's own domain joins them. places: the lexicon of countries. taxonomy: keywords and rules of the
    categories; without one the lexicon's keywords are scored, without rules. whole_texts: look at
    descriptions and places in full rather than at their beginnings.
    """
    c = F.col
    # all that Python reads comes from the raw columns and stands in one projection, so that a task has one Python process for it
    derived = {
        "__said": F.concat_ws(" ", "title", "description"),
        "__plain": T.clean_description(c("description")),
        "__offered": T.describes_remote(c("description"), None if whole_texts else T.REMOTE_TEXT),
        "title": T.strip_gender_markers(F.trim("title")),
        "url": F.trim("url"),
    }
    rows = with_salary(fenced(raw).withColumns(derived), "__said").drop("__said")
    rows = fenced(with_role_text(fenced(rows), "description", clean="__plain"))
    rows = fenced(classify(rows, taxonomy, name="job_categories") if taxonomy else with_categories(rows, lexicon, name="job_categories", text_limit=None if whole_texts else CATEGORY_TEXT))
    valid_ = F.array(*[F.lit(x) for x in valid]).cast("array<string>")
    rows = rows.withColumn("job_categories", F.array_intersect("job_categories", valid_))
    rows = fenced(with_relevance(rows, lexicon, categories="job_categories", text_limit=None if whole_texts else RELEVANCE_TEXT, clean="__plain"))
    domain = F.try_element_at(F.create_map(*[F.lit(x) for kv in (domains or {"": ""}).items() for x in kv]), F.coalesce("company_category", F.lit("-")))
    labels = F.array(*[F.lit(x) for x in lexicon.label_only]).cast("array<string>")
    rows = rows.withColumn("job_categories", F.array_intersect(with_domain(c("job_categories"), domain, labels), valid_))
    rows = rows.withColumns(
        {
            "remote": T.is_remote(c("location"), c("title")) | c("__offered") | F.coalesce("remote_hint", F.lit(False)),
            "job_type": T.job_type(c("job_type"), c("title"), T.beginning(c("description"), None if whole_texts else TYPE_TEXT)),
            "seniority": T.seniority(c("title")),
            "location": T.clean_location(c("location")),
        }
    ).drop("role_text", "remote_hint", "__plain", "__offered")
    return detect_country(rows, "location", places, max_length=None if whole_texts else MAX_LENGTH) if places is not None else rows


def rescore(jobs: DataFrame, companies: DataFrame, lexicon: Lexicon, company: str = "company_id") -> DataFrame:
    """Stored rows with categories and relevance computed anew, overrides first; rows of no company keep theirs."""
    scope = companies.select(F.col("id").alias(company), "audio_scope")
    rows = fenced(jobs.drop("audio_scope").join(scope, company))
    rows = fenced(rows.withColumn("__plain", T.clean_description(F.col("description"))))
    rows = fenced(with_categories(fenced(with_role_text(rows, "description", clean="__plain")), lexicon, name="__found").drop("job_categories"))
    rows = rows.withColumn("job_categories", F.coalesce("categories_override", "__found")).drop("__found")
    scored = fenced(with_relevance(fenced(rows), lexicon, categories="job_categories", clean="__plain").drop("role_text", "__plain"))
    return scored.withColumn("is_audio_related", effective(F.col("is_audio_related_override"), F.col("is_audio_related")))


def relabel_internships(jobs: DataFrame, title: str = "title", job_type: str = "job_type", seniority: str = "seniority") -> DataFrame:
    """Rows with internships as a level rather than a type, and `reason`: title, type_only or null. The title is trusted first; the type is then left open."""
    found = T.seniority(F.col(title))
    was = F.coalesce(F.col(job_type) == "internship", F.lit(False))
    reason = F.when((found == "internship") & (was | ~F.col(seniority).eqNullSafe(F.lit("internship"))), "title").when(was, "type_only")
    kept = [c for c in jobs.columns if c not in (job_type, seniority, "reason")]
    level = F.when(reason.isNotNull(), "internship").otherwise(F.col(seniority))
    return jobs.select(*kept, F.when(was, None).otherwise(F.col(job_type)).alias(job_type), level.alias(seniority), reason.alias("reason"))
