"""Pages of a sorted table without sorting it for every page.

A rank index is the table cut into ranges of the sort order, a folder each, with the number of rows of every range. What
comes before a range is known from the numbers, so a page reads the one or two folders that it lies in. The order has to
be total (ids break ties); it is fixed when the index is made, and so are the totals.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .board import MAX_PER_PAGE

RANGE_ROWS = 50_000


@dataclass(frozen=True)
class RankIndex:
    path: str
    #: rows of each range, and of those that count in the total
    sizes: tuple[int, ...]
    counted: int
    columns: tuple[str, ...]

    @property
    def total_rows(self) -> int:
        return sum(self.sizes)

    def ranges(self, number: int, size: int) -> tuple[list[int], int]:
        """The ranges that a page lies in, and how many rows of the first come before it."""
        start, at, out, skip = (number - 1) * size, 0, [], 0
        for i, n in enumerate(self.sizes):
            if n and at < start + size and at + n > start:
                skip = start - at if not out else skip
                out.append(i)
            at += n
        return out, max(0, skip)


def build(rows: DataFrame, order: Sequence[Column], path: str, trailing: Column | None = None, range_rows: int = RANGE_ROWS) -> RankIndex:
    """Writes the rows by ranges of the order. trailing: rows that don't count in the total. A column named range is not allowed."""
    if "range" in rows.columns:
        raise ValueError("a column named range")
    n = rows.count()
    # the driver draws a sample for every part and hears of every task, so parts are as many as other shuffles have, cut into ranges by place
    parts = max(1, min(-(-n // range_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    most = 2 * -(-n // (parts * range_rows)) or 1  # ranges of a part; the last one takes what is beyond
    place = F.monotonically_increasing_id()  # the part, and the place within it, which takes 33 bits
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", place)
    cut = F.shiftright("range", 33) * most + F.least(F.floor(F.col("range").bitwiseAND((1 << 33) - 1) / range_rows), F.lit(most - 1))
    dealt = placed.withColumn("range", cut.cast("int"))
    dealt.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    tail = trailing if trailing is not None else F.lit(False)
    counts = {r["range"]: (r["n"], r["counted"]) for r in written.groupBy("range").agg(F.count("*").alias("n"), F.count_if(~tail).alias("counted")).collect()}  # a row a range
    sizes = tuple(counts.get(i, (0, 0))[0] for i in range(max(counts, default=-1) + 1))
    index = RankIndex(path, sizes, sum(c for _, c in counts.values()), tuple(rows.columns))
    described = rows.sparkSession.createDataFrame([(json.dumps({"sizes": sizes, "counted": index.counted, "columns": index.columns, "schema": dealt.schema.json()}),)], "described string")
    described.coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return index


def opened(spark: SparkSession, path: str) -> RankIndex:
    """An index that was written before."""
    said = json.loads(spark.read.text(f"{path}/about").first()[0])
    return RankIndex(path, tuple(said["sizes"]), said["counted"], tuple(said["columns"]))


def page(spark: SparkSession, index: RankIndex, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page, in order, with `total` and `pages` on each row, as of `board.page`. order: that of the index."""
    number, size = max(1, number), min(max(1, size), MAX_PER_PAGE)
    ranges, skip = index.ranges(number, size)
    if not ranges:
        kept = spark.read.parquet(f"{index.path}/rows").where("false") if index.sizes else spark.createDataFrame([], _schema(spark, index))
    else:
        folders = [f"{index.path}/rows/range={i}" for i in ranges]  # the others aren't even listed
        rows = spark.read.option("basePath", f"{index.path}/rows").parquet(*folders)
        kept = rows.where(F.col("range").isin(*ranges)).orderBy(*order).offset(skip).limit(size)
    pages = -(-index.total_rows // size)
    return kept.select(*index.columns, F.lit(index.counted).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


def _schema(spark: SparkSession, index: RankIndex):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(json.loads(spark.read.text(f"{index.path}/about").first()[0])["schema"]))
