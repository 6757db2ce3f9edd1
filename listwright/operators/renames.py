"""Which of the added rows a deleted row has become: one to one, by evidence, then by similar names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import work_dir
from .resolve import normalize_name, similar_names

SIMILAR = 0.8


def evidence(deleted: DataFrame, added: DataFrame, key: str, columns: Mapping[str, float]) -> DataFrame:
    """(old, new, score, by): rows that share a value of a column, if one row alone has it on either side.

    A value of several deleted or several added rows says nothing; nulls and blanks are no values, case doesn't count.
    """
    out = None
    for column, weight in columns.items():
        value = F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit(""))
        one = lambda rows, name: rows.select(F.col(key).alias(name), value.alias("v")).where("v is not null").groupBy("v").agg(F.min(name).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")  # noqa: E731, B023
        pairs = one(deleted, "old").join(one(added, "new"), "v").select("old", "new", F.lit(float(weight)).alias("score"), F.lit(column).alias("by"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def assigned(pairs: DataFrame) -> DataFrame:
    """The pairs (old, new, score, by) that are left when the best goes first and takes both its rows out, the next best after it, and so on.

    Equal scores go by old, then new. All pairs that are the best of both their rows are taken at once, which comes to
    the same; rounds go on while pairs are left, each over a table that the last one wrote.
    """
    spark, schema = pairs.sparkSession, "old string, new string, score double, by string"
    best = pairs.groupBy("old", "new").agg(F.max(F.struct("score", "by")).alias("s")).select(F.col("old").cast("string"), F.col("new").cast("string"), "s.score", "s.by")
    path, number, found = work_dir(spark, "renames"), 0, None
    while True:  # a round takes the best pair that is left, at least
        best.write.parquet(f"{path}/{number}")
        left = spark.read.schema(schema).parquet(f"{path}/{number}")
        if left.isEmpty():
            return found if found is not None else left
        number += 1
        for_old = left.groupBy("old").agg(F.min(F.struct((-F.col("score")).alias("s"), "new", "by")).alias("o"))
        for_new = left.groupBy("new").agg(F.min(F.struct((-F.col("score")).alias("s"), "old")).alias("n"))
        mutual = for_old.join(for_new, (F.col("o.new") == F.col("new")) & (F.col("n.old") == F.col("old"))).select("old", "new", (-F.col("o.s")).alias("score"), F.col("o.by").alias("by"))
        mutual.write.parquet(f"{path}/taken-{number}")
        taken = spark.read.schema(schema).parquet(f"{path}/taken-{number}")
        found = taken if found is None else found.unionByName(taken)
        best = left.join(taken.select("old"), "old", "left_anti").join(taken.select("new"), "new", "left_anti")


def renames(deleted: DataFrame, added: DataFrame, key: str, name: str, columns: Mapping[str, float], similar: float = SIMILAR) -> DataFrame:
    """(old, new, score, by) of deleted rows and what they have become. columns: evidence and its weight, over 1; names count by their likeness, up to 1."""
    a = deleted.select(F.col(key).alias("old"), normalize_name(F.col(name)).alias("a")).where("length(a) > 2")
    b = added.select(F.col(key).alias("new"), normalize_name(F.col(name)).alias("b")).where("length(b) > 2")
    alike = similar_names(a, b, "a", "b", similar).select("old", "new", F.col("r").alias("score"), F.lit(name).alias("by"))
    return assigned(evidence(deleted, added, key, columns).unionByName(alike))
