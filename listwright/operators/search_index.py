"""An inverted index for word search, kept as tables, and a query that reads only the blocks of its words.

`postings`: (token, block, n, offsets), sorted by token over the files, so that Parquet's statistics lead to the row
groups of a word or of all words with a prefix. A block is a range of BLOCK ids, so even a word of every row has no
longer list than that; offsets are counted from the block's first id. `rows`: the indexed rows, a folder for each group
of blocks, so that only folders with candidates are read.

A query's terms are looked up by their parts of letters and digits: whole where the search asks for whole words or the
term goes on after them, else as prefixes. Blocks that lack one of the terms are left out before any list is opened;
what is left is checked against the rows by the patterns of the search, so the answer is that of a full scan.

Defined cases: a query without terms finds all rows; a term without letters or digits (ASCII) is only checked; rows with
a null id are not indexed; null texts have no words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search as words

BLOCK, BLOCKS_A_FOLDER = 4096, 64
_PART = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class SearchIndex:
    path: str
    id: str
    headline: tuple[str, ...]
    body: tuple[str, ...]

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("token string, block long, n int, offsets array<int>").parquet(f"{self.path}/postings")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _tokens(columns: Sequence[str]) -> Column:
    found = [F.regexp_extract_all(F.lower(F.coalesce(F.col(x).cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)) for x in columns]
    return F.array_distinct(F.concat(*found))


def build(rows: DataFrame, path: str, id: str, headline: Sequence[str], body: Sequence[str], files: int | None = None) -> SearchIndex:
    """Writes the index of the rows below path. A column named folder or block is not allowed."""
    if clash := {"folder", "block"} & set(rows.columns):
        raise ValueError(f"columns with the index's own names: {', '.join(sorted(clash))}")
    block = F.floor(F.col(id) / BLOCK).cast("long")
    kept = rows.where(F.col(id).isNotNull())
    texts = kept.select(F.col(id).cast("long").alias(id), block.alias("block"), F.explode(_tokens([*headline, *body])).alias("token"))
    listed = texts.groupBy("token", "block").agg(F.array_sort(F.collect_set((F.col(id) - F.col("block") * BLOCK).cast("int"))).alias("offsets"))  # BLOCK at most
    listed = listed.select("token", "block", F.size("offsets").alias("n"), "offsets")
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed.repartitionByRange(files, "token", "block").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{path}/postings")
    placed = kept.withColumn("block", block).withColumn("folder", F.floor(F.col("block") / BLOCKS_A_FOLDER))
    placed.repartition("folder", "block").sortWithinPartitions("folder", id).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    return SearchIndex(path, id, tuple(headline), tuple(body))


def lookups(text: str | None) -> list[tuple[str, bool]]:
    """(part, whole) of what a query's terms are looked up by."""
    found: dict[tuple[str, bool], None] = {}
    for term in words.terms(text):
        parts = _PART.findall(term)
        for i, part in enumerate(parts):
            goes_on = i + 1 < len(parts) or not term.endswith(part)
            found[part, goes_on or len(term) <= words.WHOLE_WORD_LENGTH] = None
    return list(found)


def _of(part: str, whole: bool) -> Column:
    return F.col("token") == part if whole else F.col("token").startswith(part)


def read_postings(spark: SparkSession, index: SearchIndex, text: str | None) -> DataFrame:
    """(lookup, token, block, n, offsets): the posting blocks that a query reads."""
    out = index.postings(spark).where("false").withColumn("lookup", F.lit(0))
    for i, (part, whole) in enumerate(lookups(text)):
        out = out.unionByName(index.postings(spark).where(_of(part, whole)).withColumn("lookup", F.lit(i)))
    return out


def candidates(spark: SparkSession, index: SearchIndex, text: str | None) -> DataFrame | None:
    """(block, id) of the rows that have a word for each lookup; None if there is none to look up."""
    asked = len(lookups(text))
    if not asked:
        return None
    lists = read_postings(spark, index, text)
    good = lists.groupBy("block").agg(F.count_distinct("lookup").alias("met")).where(F.col("met") == asked).select("block")
    places = lists.join(good, "block", "left_semi").select("lookup", "block", F.explode("offsets").alias("offset"))
    both = places.groupBy("block", "offset").agg(F.count_distinct("lookup").alias("met")).where(F.col("met") == asked)
    return both.select("block", (F.col("block") * BLOCK + F.col("offset")).alias(index.id))


def search(spark: SparkSession, index: SearchIndex, text: str | None) -> DataFrame:
    """The rows that the query finds, with `rank`: 0 where every term is in the headline, else 1."""
    rows = index.rows(spark)
    found = candidates(spark, index, text)
    if found is not None:
        folders = found.withColumn("folder", F.floor(F.col("block") / BLOCKS_A_FOLDER).cast(rows.schema["folder"].dataType))
        rows = rows.join(folders, ["folder", "block", index.id], "left_semi")
    head, body = [F.col(x) for x in index.headline], [F.col(x) for x in index.body]
    return rows.where(words.matches(text, head, body)).withColumn("rank", words.rank(text, head)).drop("folder", "block")
