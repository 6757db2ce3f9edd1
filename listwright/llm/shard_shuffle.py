"""Sharding by a two-pass external shuffle: a seeded scatter into memory-sized buckets, then Fisher-Yates in each.

Pass one sends every row to one of `buckets` buckets by a seeded hash of its key, so that buckets are of equal size in
expectation whatever the keys, sources or texts are. Their number follows the bytes of the corpus: a bucket is what one
task can hold. Pass two puts the rows of a bucket in the order of their hashes (so that the order in which blocks
arrive doesn't matter), runs a seeded Fisher-Yates shuffle over it and writes it. The buckets in sequence are one random
order of the corpus; shard s is the s-th of `shards` stretches of it that differ by one row at most, so the law that
holds is `rows`, and a slot is a row's place in its shard.

The rows of each bucket are counted before the scatter, from the keys alone. The counts, 8 bytes a bucket of
BUCKET_BYTES, are all that goes to the driver and to the tasks; a task that finds another number of rows than was
counted fails instead of leaving a gap.

Defined cases: a null text has no bytes and keeps its row. Keys are null or repeat: then a row's place in a written
copy of the table takes part in its hash, so that a key of a third of all rows is spread like any other, and the
order depends on how the input is cut into files; otherwise it depends on keys and seed alone. Equal rows stay as many
as they are. All columns are kept, in a struct `record`, so that no name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, sent_to_tasks, table, text_or_empty, work_dir

SHARDS = 16
SEED = 20240611
#: bytes of text that a task holds, and the least number of buckets, for the sake of many cores on small tables
BUCKET_BYTES = 256 << 20
LEAST_BUCKETS = 64
BATCH_BYTES = 4 << 20


def shard_starts(n: int, shards: int) -> np.ndarray:
    """First place of each shard in the order of all rows, and n."""
    return np.array([-(-s * n // shards) for s in range(shards + 1)], np.int64)


def fisher_yates(hashes: np.ndarray, bucket: int, seed: int) -> np.ndarray:
    """A bucket's order: its rows sorted by hash, then shuffled by a generator of its own (numpy's is Fisher-Yates)."""
    order = np.argsort(hashes, kind="stable")
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def _slices(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES."""
    size = max(1, int(len(rows) * BATCH_BYTES / max(1, rows.nbytes)))
    yield from rows.to_batches(max_chunksize=size)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes Parquet folders shard=0, 1, ... below path and reads them back: shard, slot and the row as `record`."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(text_or_empty(text)) + 1).alias("size")).first()["size"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    rows = docs.select(F.struct("*").alias("record"), F.col(key).alias("key"))
    if rows.groupBy("key").count().where("count > 1 or key is null").limit(1).count():
        rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), work_dir(spark, "shuffle-places"))
        told_apart = F.xxhash64(F.lit(seed), "key", "place")
    else:
        told_apart = F.xxhash64(F.lit(seed), "key")
    rows = rows.select("record", told_apart.alias("hash")).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    n = int(counts.sum())
    with sent_to_tasks(spark, (counts, np.cumsum(counts) - counts)) as shared:

        def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, offsets = shared.value
            starts = shard_starts(n, shards)
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            own = rows["bucket"].to_numpy()
            hashes = rows["hash"].to_numpy()
            for bucket in np.unique(own).tolist():
                at = np.flatnonzero(own == bucket)
                if len(at) != counts[bucket]:
                    raise RuntimeError(f"bucket {bucket} has {len(at)} rows where {counts[bucket]} were counted: the input changed between the passes")
                place = offsets[bucket] + np.arange(len(at), dtype=np.int64)
                shard = np.searchsorted(starts, place, side="right") - 1
                dealt = rows.select(["record"]).take(pa.array(at[fisher_yates(hashes[at], bucket, seed)]))
                dealt = dealt.append_column("slot", pa.array(place - starts[shard])).append_column("shard", pa.array(shard.astype(np.int32)))
                yield from _slices(dealt)

        schema = rows.select("record", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema
        out = rows.repartitionById(buckets, "bucket").mapInArrow(shuffled, schema)
        out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = write_shards(table(spark, sf_dir, "documents"), work_dir(spark, "op11-shards"))
    text = text_or_empty("record.text")
    return dealt.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
