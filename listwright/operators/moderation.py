"""Moderation: queues, transitions, and what an approval writes.

Every write is a merge of two tables into the next snapshot of one; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import append_link
from ..functions.money import expiry_days, featured_since, featured_until
from ..functions.search import pattern, terms
from .board import listable

STATES = ("pending", "approved", "rejected")


def queue(rows: DataFrame, state: str = "pending", status: str = "status") -> DataFrame:
    """The rows of a state, or of all."""
    if state == "all":
        return rows
    if state not in STATES:
        raise ValueError(f"no such state: {state}")
    return rows.where(F.col(status) == state)


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, columns: Sequence[str], prefix: str, how: str = "inner") -> DataFrame:
    """The rows with columns of their parent under a prefix."""
    named = parents.select(F.col(parent_key).alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return rows.join(named, key, how)


def admin_jobs(jobs: DataFrame, view: str | None = None, search: str | None = None) -> DataFrame:
    """Rows of `with_company` as moderators see them, with on_board; view: hidden, overridden or featured; any term of the search will do."""
    c = F.col
    rows = jobs.withColumn("on_board", F.coalesce(c("is_active") & c("is_audio_related") & listable(c("source"), c("is_active_override"), c("company_id"), c("company_failures")), F.lit(False)))
    views = {
        "hidden": c("is_active_override").eqNullSafe(F.lit(False)),
        "overridden": c("is_active_override").isNotNull() | c("is_audio_related_override").isNotNull() | c("categories_override").isNotNull(),
        "featured": c("featured_at").isNotNull(),
    }
    if view:
        rows = rows.where(views[view])
    wanted = F.lit(False)
    for term in terms(search):
        for column in ("title", "company_name", "url", "external_id"):
            wanted = wanted | F.coalesce(c(column).rlike(pattern(term)), F.lit(False))
    return rows.where(wanted) if terms(search) else rows


def admin_order() -> list[Column]:
    return [F.col("is_active").desc(), F.col("relevance_score").desc_nulls_last(), F.col("id").desc()]


def scrape_state(verified: Column, blocked: Column, failures: Column, last_success: Column, stale_after: int = 3) -> Column:
    """unverified, blocked, failing, never or ok."""
    return (
        F.when(~F.coalesce(verified, F.lit(False)), "unverified")
        .when(F.coalesce(blocked, F.lit(False)), "blocked")
        .when(failures >= stale_after, "failing")
        .when(last_success.isNull(), "never")
        .otherwise("ok")
    )


def live_job(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, id): for each wanted (request, url, company_id) the first live community row of that URL and company, null being a company too."""
    found = jobs.where((F.col("source") == "community") & F.col("is_active")).select("id", F.lower("url").alias("low"), F.col("company_id").alias("own"))
    asked = wanted.select("request", F.lower("url").alias("low"), "company_id")
    both = asked.join(found, (asked["low"] == found["low"]) & asked["company_id"].eqNullSafe(found["own"]), "left")
    return both.groupBy("request").agg(F.min("id").alias("id"))


def transition(rows: DataFrame, decisions: DataFrame, key: str, as_of: date, status: str = "status") -> DataFrame:
    """The rows after decisions (key, decision, reviewer, reason), with `outcome`: done, conflict (no longer pending) or kept.

    One decision a row; of several the least by reviewer counts.
    """
    one = decisions.groupBy(key).agg(F.min(F.struct("reviewer", "decision", "reason")).alias("__d"))
    both = rows.join(one, key, "left")
    asked, pending = F.col("__d").isNotNull(), F.col(status).eqNullSafe(F.lit("pending"))
    done = asked & pending
    kept = [c for c in rows.columns if c not in (status, "reviewed_by", "reviewed_at", "reason")]
    old = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("reviewed_by", "reviewed_at", "reason")}
    return both.select(
        *kept,
        F.when(done, F.col("__d.decision")).otherwise(F.col(status)).alias(status),
        F.when(done, F.col("__d.reviewer")).otherwise(old["reviewed_by"].cast("string")).alias("reviewed_by"),
        F.when(done, F.lit(as_of)).otherwise(old["reviewed_at"].cast("date")).alias("reviewed_at"),
        F.when(done, F.col("__d.reason")).otherwise(old["reason"].cast("string")).alias("reason"),
        F.when(done, "done").when(asked, "conflict").otherwise("kept").alias("outcome"),
    )


def approve_submissions(jobs: DataFrame, submissions: DataFrame, as_of: date) -> DataFrame:
    """Community rows after approvals: (id, url, company_id, title, expires_date, featured_at, featured_until, is_active, action).

    A submission refreshes the live row of its URL and company, else it becomes a row of its own (id null). Expiry and
    featuring come from the override, the request or the default.
    """
    found = live_job(jobs, submissions.select(F.col("submission_id").alias("request"), "url", "company_id")).withColumnRenamed("request", "submission_id")
    days, _ = expiry_days(F.col("override_days"), F.col("requested_days"))
    day = F.lit(as_of)
    new = submissions.join(found, "submission_id").select("id", "url", "company_id", "title", F.date_add(day, days.cast("int")).alias("expires_date"), F.col("feature_days").alias("days"), "submission_id")
    # of several submissions for one live row the last one counts
    known = new.where("id is not null").groupBy("id").agg(F.max_by(F.struct("url", "company_id", "title", "expires_date", "days"), "submission_id").alias("s"))
    before = jobs.select("id", F.col("url").alias("__url"), F.col("company_id").alias("__company"), F.col("title").alias("__title"), F.col("expires_date").alias("__expires"), "featured_at", "featured_until", "is_active")
    both = before.join(known, "id", "left")
    hit, feature = F.col("s").isNotNull(), F.col("s.days") > 0
    refreshed = both.select(
        "id", F.col("__url").alias("url"), F.col("__company").alias("company_id"), F.coalesce("s.title", "__title").alias("title"),
        F.coalesce("s.expires_date", "__expires").alias("expires_date"),
        F.when(feature, featured_since(F.col("featured_at"), F.col("featured_until"), day)).otherwise(F.col("featured_at")).alias("featured_at"),
        F.when(feature, featured_until(day, F.col("s.days"))).otherwise(F.col("featured_until")).alias("featured_until"),
        "is_active", F.when(hit, "refresh").otherwise("keep").alias("action"),
    )
    fresh = new.where("id is null")
    inserted = fresh.select(
        F.lit(None).cast("long").alias("id"), "url", "company_id", "title", "expires_date", F.when(F.col("days") > 0, day).alias("featured_at"),
        F.when(F.col("days") > 0, featured_until(day, F.col("days"))).alias("featured_until"), F.lit(True).alias("is_active"), F.lit("insert").alias("action"),
    )
    return refreshed.unionByName(inserted)


def approve_feedback(jobs: DataFrame, feedback: DataFrame, as_of: date) -> DataFrame:
    """Jobs after approved feedback (id, feedback_id, kind, suggested_categories, days), each by its kind; the last of a job counts for each kind.

    not_relevant and relevant override the relevance, categories the categories, expired and closed take a row off,
    reopen puts it back, feature features it.
    """
    kinds = feedback.groupBy("id").agg(
        F.max_by("kind", F.when(F.col("kind").isin("relevant", "not_relevant"), F.col("feedback_id"))).alias("__r"),
        F.max_by("kind", F.when(F.col("kind").isin("expired", "closed", "reopen"), F.col("feedback_id"))).alias("__a"),
        F.max_by("suggested_categories", F.when(F.col("kind") == "categories", F.col("feedback_id"))).alias("__c"),
        F.max_by("days", F.when(F.col("kind") == "feature", F.col("feedback_id"))).alias("__d"),
    )
    both, day = jobs.join(kinds, "id", "left"), F.lit(as_of)
    relevant = F.when(F.col("__r").isin("relevant", "not_relevant"), F.col("__r") == "relevant")
    active = F.when(F.col("__a").isin("expired", "closed", "reopen"), F.col("__a") == "reopen")
    new = {
        "is_audio_related_override": F.coalesce(relevant, "is_audio_related_override"),
        "is_active_override": F.coalesce(active, "is_active_override"),
        "categories_override": F.coalesce("__c", "categories_override"),
        "featured_at": F.when(F.col("__d").isNotNull(), featured_since(F.col("featured_at"), F.col("featured_until"), day)).otherwise(F.col("featured_at")),
        "featured_until": F.when(F.col("__d").isNotNull(), featured_until(day, F.col("__d"))).otherwise(F.col("featured_until")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def approve_suggestions(companies: DataFrame, suggestions: DataFrame, columns: Sequence[str], key: str = "id", links: str = "community_links") -> DataFrame:
    """Companies after approved suggestions (id, suggestion_id, columns, link): values that are given replace, a link is added if new, and the row is manual from then on."""
    last = suggestions.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("suggestion_id"))).alias(f"__{c}") for c in columns], F.max_by("link", F.when(F.col("link").isNotNull(), F.col("suggestion_id"))).alias("__link"), F.lit(True).alias("__hit"))
    both = companies.join(last, key, "left")
    new = {c: F.coalesce(f"__{c}", c) for c in columns}
    new[links] = F.when(F.col("__link").isNotNull(), append_link(F.col(links), F.col("__link"))).otherwise(F.col(links))
    new["source"] = F.when(F.col("__hit"), "manual").otherwise(F.col("source"))
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in companies.columns])


def checked_submissions(submissions: DataFrame, companies: DataFrame, categories: Sequence[str], name: str = "company_name") -> DataFrame:
    """Submissions with the id of the company of that name (case ignored) and `problem`: missing_title, bad_url, unknown_category or null."""
    known = companies.groupBy(F.lower(F.trim("name")).alias("__name")).agg(F.min("id").alias("company_id"))
    strange = F.size(F.array_except(F.coalesce("categories", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in categories])))
    problem = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title").when(~F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)), "bad_url").when(strange > 0, "unknown_category")
    kept = [c for c in submissions.columns if c not in ("company_id", "problem")]
    return submissions.select(*kept, F.lower(F.trim(name)).alias("__name"), problem.alias("problem")).join(known, "__name", "left").select(*kept, "company_id", "problem")


def delete_cascaded(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], detached: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """The tables without the parents in `gone`: children go with them, rows of `detached` stay without a parent."""
    keys = gone.select(key).distinct()
    out = {"parents": parents.join(keys, key, "left_anti")}
    for name, (rows, foreign) in children.items():
        out[name] = rows.join(keys.withColumnRenamed(key, foreign), foreign, "left_anti").select(*rows.columns)
    for name, (rows, foreign) in (detached or {}).items():
        mark = keys.select(F.col(key).alias(foreign), F.lit(True).alias("__gone"))
        out[name] = rows.join(mark, foreign, "left").select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == foreign else F.col(c) for c in rows.columns])
    return out
