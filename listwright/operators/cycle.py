"""A fetch cycle: which sources, what is written for each outcome, and what it adds up to."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import effective, reconcile


def population(companies: DataFrame, verified: str = "verified", url: str = "careers_url", blocked: str = "scrape_blocked") -> DataFrame:
    """Companies that are fetched: verified, with a URL, and not blocked (an unknown answer is no block)."""
    return companies.where(F.col(verified).eqNullSafe(F.lit(True)) & F.col(url).isNotNull() & ~F.col(blocked).eqNullSafe(F.lit(True)))


def fetch_order(priority: Column, name: Column) -> list[Column]:
    """Priority sources first, each part by name."""
    return [F.coalesce(priority, F.lit(False)).desc(), F.lower(name).asc()]


def fill_descriptions(fetched: DataFrame, stored: DataFrame, keys: Sequence[str], description: str = "description") -> DataFrame:
    """Fetched rows with the stored description where they come with none."""
    known = stored.groupBy(*keys).agg(F.max(description).alias("__known"))
    both = fetched.join(known, list(keys), "left")
    filled = F.coalesce(F.nullif(F.trim(description), F.lit("")), "__known")
    return both.select(*[filled.alias(c) if c == description else F.col(c) for c in fetched.columns])


def persist(jobs: DataFrame, fetched: DataFrame, outcomes: DataFrame, companies: DataFrame, columns: Sequence[str], as_of: date, company: str = "company_id", identity: str = "identity", description: str = "description") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, companies, log rows) after a cycle's outcomes (company, status, trust_empty, allow_deactivation).

    A failure adds one to the company's failures and touches no row; a success fills in stored descriptions, merges the
    rows and sets the failures to 0. Both are logged.
    """
    good = outcomes.where("status = 'success'").select(company, "trust_empty", "allow_deactivation")
    keys = [company, identity]
    rows = fill_descriptions(fetched.join(good.select(company), company, "left_semi"), jobs, keys, description)
    merged = reconcile(jobs, rows, good, keys, columns, keep_if_null=[description])
    counts = rows.groupBy(company).agg(F.count("*").alias("jobs_found"))
    log = outcomes.join(counts, company, "left").select(company, F.lit(as_of).alias("started_at"), "status", F.coalesce("jobs_found", F.lit(0)).alias("jobs_found"))
    state = outcomes.select(F.col(company).alias("id"), F.col("status").alias("__status"))
    failures = F.when(F.col("__status") == "success", 0).when(F.col("__status").isNotNull(), F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    after = companies.join(state, "id", "left").select(*[failures.alias(c) if c == "consecutive_failures" else F.col(c) for c in companies.columns])
    return merged, after, log


def deactivate(jobs: DataFrame, companies: DataFrame, company: str = "company_id", active: str = "is_active", override: str = "is_active_override") -> DataFrame:
    """Jobs of the given companies (id) go off, unless their override keeps them; community rows stay."""
    mark = companies.select(F.col("id").alias(company), F.lit(True).alias("__off")).distinct()
    off = F.coalesce(F.col("__off"), F.lit(False)) & (F.col("source") != "community") & F.col(active)
    return jobs.join(mark, company, "left").select(*[F.when(off, effective(F.col(override), F.lit(False))).otherwise(F.col(active)).alias(c) if c == active else F.col(c) for c in jobs.columns])


def recomputed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: total, and for each column the number of rows where its value changed."""
    old = before.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = after.select(key, *columns).join(old, key)
    return both.agg(F.count("*").alias("total"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"{c}_changed") for c in columns])


def cycle_totals(outcomes: DataFrame, merged: DataFrame, status: str = "status", method: str = "method", found: str = "jobs_found") -> tuple[DataFrame, DataFrame]:
    """One row of a cycle's counters, and the number of sources of each method, the commonest first."""
    a = F.col("action")
    fetched = outcomes.agg(F.count("*").alias("companies"), F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(F.col(status) != "success").alias("failed"), F.coalesce(F.sum(found), F.lit(0)).alias("jobs_found"))
    written = merged.agg(*[F.count_if(a == x).alias(n) for x, n in (("insert", "inserted"), ("update", "updated"), ("reactivate", "reactivated"), ("deactivate", "deactivated"), ("keep", "kept"))], F.count_if("skipped").alias("skipped"))
    return fetched.crossJoin(F.broadcast(written)), frequency(outcomes, F.coalesce(method, F.lit("none")).alias("method"))


def frequency(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, n), the commonest first, equal ones by key."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in counted.columns[:-1]])


def discovery_population(unverified: DataFrame, failing: DataFrame, key: str) -> DataFrame:
    """Both populations, each company once; the failing row wins."""
    both = unverified.withColumn("__place", F.lit(0)).unionByName(failing.withColumn("__place", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*unverified.columns), "__place").alias("r"))
    return best.select("r.*")


def merged_urls(rows: DataFrame, company: str, url_order: str, identity: str, method: str) -> tuple[DataFrame, DataFrame]:
    """(rows, methods) of companies read at several URLs: of each identity the row of the first URL, and the methods used, joined by `+`."""
    first = rows.groupBy(company, identity).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (company, identity)]), url_order).alias("r"))
    used = rows.groupBy(company, method).agg(F.min(url_order).alias("__at"))
    methods = used.groupBy(company).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", method))), lambda x: x[method]), "+").alias("methods"))
    return first.select(company, identity, "r.*"), methods


def claimed_elsewhere(rows: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """The rows whose binding another owner holds too."""
    held = rows.groupBy(*keys).agg(F.min(owner).alias("__low"), F.max(owner).alias("__high")).where("__low <> __high")
    return rows.join(held.select(*keys), list(keys), "left_semi")
