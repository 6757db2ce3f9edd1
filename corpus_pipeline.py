"""The corpus pipeline: language ID, line dedup, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of `documents`, whatever else the table has; the columns `copy`,
`n_copies` and `order_key` are the mixing stage's own and replaced. A table without rows passes through all stages. Texts
without a letter, null ones among them, go with the language stage; rows without an id or source, equal rows and very
long texts are documents like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from listwright.llm.common import saved, table, work_dir
from listwright.llm.jaccard_join import stage_jaccard_join
from listwright.llm.language_id import stage_language_id
from listwright.llm.line_dedup import drop_spread_lines
from listwright.llm.mixing import mix_sources
from listwright.llm.trie_bpe import encode_documents


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a document count once, so that the next stage still has their text to choose one from."""
    return drop_spread_lines(docs, copies_once=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a document are equal rows, in an order that is random over all of them."""
    return mix_sources(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", stage_jaccard_join),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: centroids, shingle joins and BPE are beyond SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
