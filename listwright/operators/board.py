"""The listings board: filters, order, pages, counts. Column names are parameters with the domain's names as defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import search as words
from ..functions.dates import seen_date

STALE_AFTER_FAILURES = 3
MAX_PER_PAGE = 100


def _values(value: str | Sequence[str] | None) -> list[str]:
    given = [value] if isinstance(value, str) else list(value or ())
    return [v.strip().lower() for v in given if v and v.strip()]


@dataclass(frozen=True)
class JobFilter:
    """What a board request may ask for. `ids=()` asks for no row, None does not filter."""

    category: Sequence[str] = ()
    seniority: str | Sequence[str] | None = None
    job_type: str | Sequence[str] | None = None
    salary_min: int | None = None
    salary_max: int | None = None
    company_id: int | None = None
    company: str | None = None
    location: str | None = None
    country: str | None = None
    remote: bool | None = None
    search: str | None = None
    include_unrelated: bool = False
    ids: Sequence[int] | None = None
    untyped_last: bool = False


def with_company(jobs: DataFrame, companies: DataFrame, job_key: str = "company_id", company_key: str = "id", name: str = "name", failures: str = "consecutive_failures") -> DataFrame:
    """Jobs with their company's name and failures (`company_name`, `company_failures`); a job without a company stays."""
    parent = companies.select(F.col(company_key).alias(job_key), F.col(name).alias("company_name"), F.col(failures).alias("company_failures"))
    return jobs.join(parent, job_key, "left")


def listable(source: Column, override: Column, company: Column, failures: Column) -> Column:
    """Community rows, rows forced on, rows without a company, and rows of a company that was fetched lately."""
    return (source == "community") | F.coalesce(override, F.lit(False)) | company.isNull() | F.coalesce(failures < STALE_AFTER_FAILURES, F.lit(False))


def featured(at: Column, until: Column, as_of: date) -> Column:
    return at.isNotNull() & (until.isNull() | (until >= F.lit(as_of)))


def overlaps(low: Column, high: Column, wanted_low: float | None, wanted_high: float | None) -> Column:
    """Ranges with open ends that meet the wanted one."""
    out = F.lit(True)
    if wanted_low is not None:
        out = out & (high.isNull() | (high >= wanted_low))
    if wanted_high is not None:
        out = out & (low.isNull() | (low <= wanted_high))
    return out


def filter_jobs(jobs: DataFrame, f: JobFilter) -> DataFrame:
    """Rows of `with_company` that a request is to see."""
    c = F.col
    out = jobs.where(c("is_active") & listable(c("source"), c("is_active_override"), c("company_id"), c("company_failures")))
    if f.ids is not None:
        out = out.where(c("id").isin(*f.ids) if f.ids else F.lit(False))
    if not f.include_unrelated:
        out = out.where(c("is_audio_related"))
    if levels := _values(f.seniority):
        out = out.where(c("seniority").isin(*levels))
    if types := _values(f.job_type):
        out = out.where(c("job_type").isin(*types) | (c("job_type").isNull() if f.untyped_last else F.lit(False)))
    if f.company_id is not None:
        out = out.where(c("company_id") == f.company_id)
    if f.company and f.company.strip():
        out = out.where(c("company_name").ilike(f"%{f.company.strip()}%"))
    if f.remote is not None:
        out = out.where(c("remote").eqNullSafe(f.remote))
    if f.location:
        out = out.where(c("location").ilike(f"%{f.location}%"))
    if f.country:
        out = out.where((c("country") == f.country.upper()) | c("country").isNull())
    out = out.where(overlaps(c("salary_min"), c("salary_max"), f.salary_min, f.salary_max))
    if f.search:
        out = out.where(words.matches(f.search, [c("title"), c("company_name")], [c("description")]))
    if f.category:
        out = out.where(F.arrays_overlap(c("job_categories"), F.array(*[F.lit(x) for x in f.category])))
    return out


def job_order(sort: str = "newest", country_first: str | None = None, search: str | None = None, untyped_last: bool = False) -> list[Column]:
    """Sort keys: unknown types last, headline matches first, the wanted country first, then the sort; ids break ties."""
    c = F.col
    seen = seen_date(c("posted_date"), c("created_at"))
    base = {
        "newest": [seen.desc_nulls_last(), c("created_at").desc_nulls_last()],
        "oldest": [seen.asc_nulls_last(), c("created_at").asc_nulls_last()],
        "salary_desc": [F.coalesce("salary_max", "salary_min", F.lit(0)).desc(), seen.desc_nulls_last()],
        "salary_asc": [F.coalesce("salary_max", "salary_min", F.lit(1_000_000_000)).asc(), seen.desc_nulls_last()],
    }
    keys = list(base.get(sort, base["newest"]))
    if country_first:
        keys.insert(0, F.when(c("country") == country_first.upper(), 0).otherwise(1).asc())
    if words.terms(search):
        keys.insert(0, words.rank(search, [c("title"), c("company_name")]).asc())
    if untyped_last:
        keys.insert(0, F.when(c("job_type").isNull(), 1).otherwise(0).asc())
    return [*keys, c("id").asc()]


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int, trailing: Column | None = None) -> DataFrame:
    """One page with `total` (without trailing rows) and `pages` (with them) on each row.

    The totals are one map-side combined row; the page is a top-k of number * size rows, never a full sort.
    """
    number, size = max(1, number), min(max(1, size), MAX_PER_PAGE)
    tail = trailing if trailing is not None else F.lit(False)
    counts = rows.agg(F.count_if(~tail).alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))
    part = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(counts))


def first_by(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def child_counts(parents: DataFrame, children: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Parents with counts of their children where the condition holds, 0 without any; children are counted before the join."""
    sums = children.groupBy(key).agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    return parents.join(sums, key, "left").fillna(0, list(counts))


def array_counts(rows: DataFrame, column: str, dimension: DataFrame | None = None, key: str = "value") -> DataFrame:
    """(key, n) of the array's elements; with a dimension, a row for each of its values, 0 if unused."""
    found = rows.select(F.explode(column).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return found if dimension is None else dimension.join(found, key, "left").fillna(0, ["n"])


def code_counts(rows: DataFrame, code: str, known: DataFrame, known_code: str) -> DataFrame:
    """(code, n); null for missing codes and those not in `known`."""
    joined = rows.select(F.col(code).alias("__code")).join(known.select(F.col(known_code).alias("code")), F.col("__code") == F.col("code"), "left")
    return joined.groupBy("code").agg(F.count("*").alias("n"))
