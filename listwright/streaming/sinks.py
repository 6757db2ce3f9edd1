"""Sinks that keep state and may see a batch again: each batch's state is a version named by its id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FailureCounts:
    """A foreachBatch sink: by key, the failures since its last success.

    The state after a batch is a folder with the batch's id, made from the newest folder of a lower id. A batch that
    comes again, after a crash or a restart, starts from the same folder and writes the same state over its own, so
    nothing counts twice. Rows of a batch are taken in the order of their places.
    """

    path: str
    key: str
    failed: str
    place: str

    def _before(self, spark: SparkSession, batch_id: int | None) -> DataFrame:
        marks = spark.read.schema("value string, batch long").text(f"{self.path}/done") if self._begun(spark) else None
        last = marks.where(F.lit(True) if batch_id is None else F.col("batch") < batch_id).agg(F.max("batch")).first()[0] if marks is not None else None
        empty = spark.createDataFrame([], f"{self.key} string, failures long")
        return empty if last is None else spark.read.schema(empty.schema).parquet(f"{self.path}/state/batch={last}")

    def _begun(self, spark: SparkSession) -> bool:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True)
        try:
            return bool(files.load(f"{self.path}/done").select("path").head(1))
        except Exception as e:  # no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(self.key).cast("string").alias(self.key), F.col(self.failed).alias("failed"), F.col(self.place).alias("place")).where(F.col(self.key).isNotNull())
        success = rows.where("not failed").groupBy(self.key).agg(F.max("place").alias("success"))
        counted = rows.join(success, self.key, "left").groupBy(self.key).agg(F.count_if(F.col("failed") & (F.col("success").isNull() | (F.col("place") > F.col("success")))).alias("n"), F.max("success").isNotNull().alias("reset"))
        old = self._before(spark, batch_id)
        both = old.join(counted, self.key, "full_outer")
        base = F.when(F.coalesce("reset", F.lit(False)), 0).otherwise(F.coalesce("failures", F.lit(0)))
        new = both.select(self.key, (base + F.coalesce("n", F.lit(0))).cast("long").alias("failures"))
        new.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        spark.createDataFrame([("done",)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/done/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, failures) after the newest batch."""
        return self._before(spark, None)


def sessions(hits: DataFrame, key: str, ts: str, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """(key, begins, ends, n): stretches of hits of a key with `gap` at most between neighbours. lateness: for streams, how late hits may come."""
    rows = hits.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", lateness) if lateness else rows
    window: Column = F.session_window("__ts", gap)
    found = rows.groupBy(window.alias("w"), key).agg(F.min("__ts").alias("begins"), F.max("__ts").alias("ends"), F.count("*").alias("n"))
    return found.select(key, "begins", "ends", "n")
