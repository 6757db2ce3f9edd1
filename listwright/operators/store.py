"""Stored tables that are written in part: buckets by key, versions of buckets, and a manifest that says which count.

An update reads and writes the buckets of the keys that it touches; the others stay as they are. What it writes gets a
version of its own and counts only once the manifest of that version is there, so whatever fails before leaves the table
as it was, and readers of the old state go on. The rows of the change are kept beside the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

NAMES = ("version", "bucket")


@dataclass(frozen=True)
class Store:
    path: str
    key: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession) -> dict:
        """The newest: version, schema, and the version of each bucket that has rows."""
        rows = spark.read.schema("value string, version int").text(f"{self.path}/manifest")
        return json.loads(rows.agg(F.max_by("value", "version")).first()[0])

    def _publish(self, spark: SparkSession, version: int, schema: dict, buckets: dict[int, int]) -> None:
        said = json.dumps({"version": version, "schema": schema, "buckets": {str(k): v for k, v in sorted(buckets.items())}})
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/version={version}")

    def _write(self, rows: DataFrame, version: int) -> set[int]:
        """Writes the rows as a version; the buckets that have some."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        spark = rows.sparkSession
        schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
        there = spark.read.schema(schema).parquet(f"{self.path}/data/version={version}").select("bucket").distinct()
        return {r["bucket"] for r in there.collect()}  # buckets at most

    def create(self, rows: DataFrame) -> None:
        if clash := set(NAMES) & set(rows.columns):
            raise ValueError(f"columns with the store's own names: {', '.join(sorted(clash))}")
        self._publish(rows.sparkSession, 0, json.loads(rows.schema.json()), dict.fromkeys(self._write(rows, 0), 0))

    def read(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame:
        """The rows as of the newest manifest, of all buckets or of some."""
        state = self.manifest(spark)
        schema = StructType.fromJson(state["schema"])
        by_version: dict[int, list[int]] = {}
        for b, v in state["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_version.setdefault(v, []).append(int(b))
        full = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("version", IntegerType())])
        rows = spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}" for v in by_version]) if by_version else spark.createDataFrame([], full)
        counts = F.lit(False)
        for v, some in by_version.items():
            counts = counts | ((F.col("version") == v) & F.col("bucket").isin(some))
        return rows.where(counts).select(*schema.names)

    def update(self, changes: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> dict:
        """Rewrites the buckets of the keys in `changes` by merge(their rows), and keeps `changes`. Says what was written."""
        spark = changes.sparkSession
        state = self.manifest(spark)
        version = state["version"] + 1
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")
        kept = spark.read.schema(changes.schema).parquet(f"{self.path}/changes/version={version}")
        touched = {r["bucket"] for r in kept.select(self.bucket().alias("bucket")).distinct().collect()}  # buckets at most
        names = StructType.fromJson(state["schema"]).names
        new = merge(self.read(spark, touched)).select(*names)
        written = self._write(new, version)  # over what an unfinished update of that number has left
        if written - touched:
            raise ValueError("the merge made rows of keys that the changes don't have")
        buckets = {int(k): v for k, v in state["buckets"].items() if int(k) not in touched} | dict.fromkeys(written, version)
        self._publish(spark, version, state["schema"], buckets)
        return {"version": version, "touched": len(touched), "buckets": len(buckets)}

    def changes(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/changes/version={version}")
