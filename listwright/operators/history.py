"""Event histories: latest row, leading runs, first-wins dedupe, unique slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import work_dir


def latest(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns of each group's greatest row; one map-side combined aggregate, so a hot group is no hot task."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in keep])


def leading_run(rows: DataFrame, key: str, order: Sequence[str], holds: Column, name: str = "run") -> DataFrame:
    """(key, run): how many of the newest rows of each group hold before the first that does not.

    The newest other row is an aggregate; rows after it are counted. No group is sorted or gathered.
    """
    at = F.struct(*order)
    stop = rows.groupBy(key).agg(F.max(F.when(~F.coalesce(holds, F.lit(False)), at)).alias("stop"))
    joined = rows.select(key, at.alias("at")).join(stop, key)
    return joined.groupBy(key).agg(F.count_if(F.col("stop").isNull() | (F.col("at") > F.col("stop"))).alias(name))


def first_wins(rows: DataFrame, key: Column | str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the least by order."""
    k = F.col(key) if isinstance(key, str) else key
    best = rows.withColumn("__key", k).groupBy("__key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def ranked(rows: DataFrame, key: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """The rows with 1, 2, 3, … in order within each key; a key of any size is spread over all tasks.

    Rows are dealt by ranges of key and order and written once; each range counts its own rows of a key, and starts after
    what the ranges before it hold of that key.
    """
    dealt = rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    path = work_dir(rows.sparkSession, "ranked")
    dealt.write.parquet(path)
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = stored.groupBy(key, "__part").agg(F.count("*").alias("__count"))  # a row for each range that a key is in
    before = F.sum("__count").over(Window.partitionBy(key).orderBy("__part")) - F.col("__count")
    own = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))
    both = stored.withColumn("__own", own).join(counts.select(F.col(key).alias("__key"), F.col("__part").alias("__p"), before.alias("__before")), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return both.select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))


def unique_slugs(rows: DataFrame, slug: str, order: Sequence[str], name: str = "unique_slug") -> DataFrame:
    """base, base-2, base-3, … in order within each base; numbers that another row's own slug has are left out."""
    numbered = rows.select(F.regexp_extract(slug, r"^(.*)-\d+$", 1).alias("__base"), F.regexp_extract(slug, r"-(\d+)$", 1).try_cast("int").alias("__number")).where("__number >= 2")
    used = numbered.groupBy("__base").agg(F.array_sort(F.collect_set("__number")).alias("__used"))
    both = ranked(rows, slug, order, "__n").join(used, F.col(slug) == F.col("__base"), "left")
    number = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__n").cast("int"), lambda n, taken: F.when(taken <= n, n + 1).otherwise(n))
    return both.select(*rows.columns, F.when(F.col("__n") == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), number)).alias(name))


def merge_listings(rows: DataFrame, key: str, group: str, order: Sequence[str], location: str) -> DataFrame:
    """Rows deduped by key (first wins), then grouped: the first row of each group with all its locations, distinct, in order."""
    ranked = first_wins(rows, key, order)
    places = ranked.where(F.col(location).isNotNull()).groupBy(group, location).agg(F.min(F.struct(*order)).alias("at"))
    listed = places.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", location))), lambda x: x[location]), "; ").alias("locations"))
    return first_wins(ranked, group, order).drop(location).join(listed, group, "left")
