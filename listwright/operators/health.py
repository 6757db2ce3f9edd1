"""Health of sources: shares, grades, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIBED_FROM, FURNITURE_ROWS, FURNITURE_ROLE_SHARE, THIN_SHARE = 200, 3, 0.25, 0.2
GRADES = ("failing", "silent", "furniture", "thin", "idle", "healthy", "unscraped")


def is_described(text: Column) -> Column:
    return F.coalesce(F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))) >= DESCRIBED_FROM, F.lit(False))


def share(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part / total, 2)).otherwise(F.lit(0.0))


def in_population(verified: Column, url: Column, blocked: Column) -> Column:
    return F.coalesce(verified, F.lit(False)) & url.isNotNull() & ~F.coalesce(blocked, F.lit(False))


def grade(rows: Column, described: Column, roles: Column, board: Column, status: Column, scraped: Column) -> Column:
    return (
        F.when(~scraped, "unscraped")
        .when(status == "failed", "failing")
        .when(rows == 0, "silent")
        .when((rows >= FURNITURE_ROWS) & (described == 0) & (roles < FURNITURE_ROLE_SHARE), "furniture")
        .when((rows >= FURNITURE_ROWS) & (described < THIN_SHARE), "thin")
        .when(board == 0, "idle")
        .otherwise("healthy")
    )


def grade_rank(value: Column) -> Column:
    out = F.lit(len(GRADES))
    for i, g in enumerate(GRADES):
        out = F.when(value == g, i).otherwise(out)
    return out


def truncated(metrics: DataFrame, caps: dict[str, int], method: str = "scrape_method", found: str = "jobs_found", urls: str = "careers_url_count") -> DataFrame:
    """Sources that returned as many rows as their method can return, with that cap."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(method)) * F.greatest(F.lit(1), F.col(urls))
    return metrics.withColumn("cap", cap).where(F.col(found) >= F.col("cap"))


def class_histogram(rows: DataFrame, key: str, label: Column, labels: tuple[str, ...]) -> DataFrame:
    """(key, total, one count a label)."""
    return rows.withColumn("__label", label).groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("__label") == x).alias(x) for x in labels])


def mode_with_lead(rows: DataFrame, key: str, value: str, lead: str, length: Column) -> DataFrame:
    """(key, value, n, lead): each group's commonest value, the least of equals, and in it the shortest, commonest, least lead."""
    leads = rows.groupBy(key, value, lead).agg(F.count("*").alias("n"), F.min(length).alias("length"))
    values = leads.groupBy(key, value).agg(F.sum("n").alias("n"), F.min(F.struct("length", -F.col("n"), lead)).alias("first"))
    best = values.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(value), F.col(f"first.{lead}").alias(lead))).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), (-F.col("b.col1")).alias("n"), F.col(f"b.{lead}").alias(lead))


def bucket_summary(rows: DataFrame, key: str, bucket: str, wanted: str, example: str, examples: int = 3) -> DataFrame:
    """(key, n, total, examples): rows in the wanted bucket of each group that has any, and its first few examples.

    The examples are an aggregate of the few least values, combined map-side: array_agg of a whole group never forms.
    """
    hit = F.col(bucket) == wanted
    counts = rows.groupBy(key).agg(F.count_if(hit).alias("n"), F.count("*").alias("total")).where("n > 0")
    few = rows.where(hit).groupBy(key, example).agg(F.lit(1).alias("one"))
    from pyspark.sql import Window

    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(example))).where(F.col("r") <= examples)
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(listed, key)


def evaluate_labels(cases: DataFrame, predicted: str, acceptable: str) -> DataFrame:
    """One row: total, covered, hit, clean, predicted and wrong labels."""
    wrong = F.array_except(predicted, acceptable)
    any_ = F.size(predicted) > 0
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(any_).alias("covered"),
        F.count_if(F.arrays_overlap(predicted, acceptable)).alias("hit"),
        F.count_if(any_ & (F.size(wrong) == 0)).alias("clean"),
        F.sum(F.size(predicted)).cast("long").alias("predicted_labels"),
        F.sum(F.size(wrong)).cast("long").alias("wrong_labels"),
    )
