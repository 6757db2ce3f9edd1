"""Lifecycle of listings: snapshot merge with overrides, expiry, diffs, orphans, shared boards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(override: Column, computed: Column) -> Column:
    return F.coalesce(override, computed)


def reconcile(existing: DataFrame, fetched: DataFrame, outcomes: DataFrame, keys: Sequence[str], columns: Sequence[str], keep_if_null: Sequence[str] = (), active: str = "is_active", override: str = "is_active_override") -> DataFrame:
    """The next state of stored rows, with `action` and `skipped`.

    keys: the parent and the row identity. outcomes: one row a parent, with trust_empty and allow_deactivation; parents
    without one, as after a failed fetch, keep their rows. Fetched rows overwrite the columns (those in keep_if_null only
    by a value), revive an inactive row unless its override says no, and are inserted if new. Active rows that were not
    fetched are deactivated if the parent allows it and was read wholly or had rows at all, and their override agrees.
    """
    parent = keys[0]
    had = fetched.groupBy(parent).agg(F.count("*").alias("__rows"))
    can = (F.col("allow_deactivation") & (F.col("trust_empty") | (F.coalesce("__rows", F.lit(0)) > 0))).alias("__can")
    state = outcomes.join(had, parent, "left").select(parent, can)
    new = fetched.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__fetched"))
    old = existing.withColumn("__stored", F.lit(True))
    both = old.join(new, list(keys), "full_outer").join(state, parent, "left")
    seen, stored, can = F.coalesce("__fetched", F.lit(False)), F.coalesce("__stored", F.lit(False)), F.col("__can")
    was = F.coalesce(F.col(active), F.lit(False))
    revived = seen & stored & ~was & effective(F.col(override), F.lit(True))
    dropped = ~seen & was & F.coalesce(can, F.lit(False)) & ~effective(F.col(override), F.lit(False))
    action = (
        F.when(seen & ~stored, "insert").when(revived, "reactivate").when(seen, "update").when(dropped, "deactivate").otherwise("keep")
    )
    values = [F.when(seen, F.coalesce(f"__new_{c}", c) if c in keep_if_null else F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    rest = [c for c in existing.columns if c not in (*keys, *columns, active)]
    skipped = ~seen & was & ~F.coalesce(can, F.lit(True))
    now_active = F.when(seen & ~stored | revived, True).when(dropped, False).otherwise(was)
    return both.select(*keys, *values, *rest, now_active.alias(active), action.alias("action"), skipped.alias("skipped"))


def reconcile_counts(merged: DataFrame) -> DataFrame:
    a = F.col("action")
    return merged.agg(F.count_if(a == "insert").alias("inserted"), F.count_if(a.isin("update", "reactivate")).alias("updated"), F.count_if(a == "reactivate").alias("reactivated"), F.count_if(a == "deactivate").alias("deactivated"), F.count_if("skipped").alias("skipped"))


def expire(rows: DataFrame, as_of: date, expires: str = "expires_date", active: str = "is_active", override: str = "is_active_override") -> DataFrame:
    over = F.col(active) & F.coalesce(F.col(expires) < F.lit(as_of), F.lit(False))
    return rows.withColumn(active, F.when(over, effective(F.col(override), F.lit(False))).otherwise(F.col(active)))


def keyed_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change, fields): added, deleted or changed rows, and the names of the changed columns."""
    old = before.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    new = after.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("now"))
    both = old.join(new, key, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), c) for c in columns]))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.size(fields) > 0, "changed")
    named = F.when(change == "changed", F.array_join(fields, ",")).otherwise("")
    return both.select(key, change.alias("change"), named.alias("fields")).where(F.col("change").isNotNull())


def orphans(stored: DataFrame, seed: DataFrame, key: str, **dependents: DataFrame) -> DataFrame:
    """Stored rows that the seed lacks, with the numbers of rows that depend on them."""
    out = stored.join(seed.select(key).distinct(), key, "left_anti")
    for name, rows in dependents.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return out


def shared_bindings(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name, shared_with): how many others hold the same binding; rows that share none are left out."""
    held = rows.groupBy(*keys).agg(F.count("*").alias("holders"), F.min(name).alias("first_holder")).where("holders > 1")
    return rows.join(held, list(keys)).select(*keys, name, (F.col("holders") - 1).alias("shared_with"), "first_holder")
