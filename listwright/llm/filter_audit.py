"""Audit of how filters interact: what each removes, at each step of every order in which they can be applied.

A document is known by its mask, one bit for each filter that it fails. FIRST, 32 masks by 120 orders, says at which
step a document is removed. A task indexes it with the masks of its documents and counts with np.bincount by part,
order, step and label; all figures asked for are sums over documents, so a task works them out for its own, and Spark
sums the tasks' arrays. Filter E needs the whole table: the smallest doc_id of each text, by its SHA-256.

A task sends 600 rows for each part that it has met; beyond PARTS_HELD parts it sends them early, so its memory doesn't
follow the number of parts. Texts are read once: ids, parts, masks and digests are written and read from then on. A text
of many copies is one row of the join's other side, and Spark splits its rows between tasks.

Defined cases: a null text counts as empty and is identical to empty ones; a null source is the part of the empty
string; a document without doc_id is never removed by E and has no label; of rows with one doc_id none is smaller than
the others. Several labels of a document: good or toxic if any of them is so. Repeated rows count as often as they
occur. An empty table has no part and gives no row. Other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, row_chunks, saved, string_bytes, table, work_dir

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
PARTS_HELD = 2000
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

#: the filter at each step of each order, as its number
AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: by mask and order: the step of the first filter that fails, STEPS if none does
_FAILS = (np.arange(1 << STEPS)[:, None, None] >> AT[None]) & 1
FIRST = np.where(_FAILS.any(2), _FAILS.argmax(2), STEPS)

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*|")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def own_failures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D for each row."""
    words = Words(raw, offsets, lower=False)
    n = len(offsets) - 1
    count = np.bincount(words.row, minlength=n)
    order = np.lexsort((words.hash, words.row))
    h, row = words.hash[order], words.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=n)
    points = _per_row((raw & 0xC0) != 0x80, offsets)
    fails = (count < MIN_WORDS, 100 * distinct < MIN_DISTINCT * count, 100 * _per_row(_CAPITAL[raw], offsets) > MAX_CAPITALS * points, _per_row(_MARK[raw], offsets) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text) to (doc_id, part, mask of A to D, SHA-256 of the text)."""
    for batch in batches:
        raw, offsets = string_bytes(batch.column(2))
        mask = np.zeros(batch.num_rows, np.int32)
        for a, b in row_chunks(offsets):
            mask[a:b] = own_failures(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        digest = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])


def figures(removed: np.ndarray, masks: np.ndarray) -> list[np.ndarray]:
    """FIGURES of one part, 120 orders by 5 steps. removed: by order, step and label (1 good, 2 toxic); masks: documents by mask."""
    here = removed.sum(2)[:, :STEPS]
    fails = np.array([masks[(np.arange(1 << STEPS) >> f) & 1 == 1].sum() for f in range(STEPS)])
    alone = masks[1 << np.arange(STEPS)]
    shapley = np.bincount(AT.ravel(), here.ravel(), STEPS).astype(np.int64)
    return [masks.sum() - here.cumsum(1), here, fails[AT] - here, alone[AT], removed[:, :STEPS, [1, 3]].sum(2), removed[:, :STEPS, [2, 3]].sum(2), shapley[AT]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, label) to the FIGURES of each part, order and step over the task's documents."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    order = np.arange(len(ORDERS))

    def sent() -> Iterator[pa.RecordBatch]:
        for part, (removed, masks) in held.items():
            columns = [pa.array([part] * (len(ORDERS) * STEPS)), pa.array(np.repeat(ORDERS, STEPS).tolist()), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x.ravel().astype(np.int64)) for x in figures(removed, masks)], ["part", "filter_order", "step", *FIGURES])
        held.clear()

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names = coded.dictionary.to_pylist()
        part, mask, label = coded.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        masks = np.bincount(part * 32 + mask, minlength=len(names) * 32).reshape(-1, 32)
        where = (part[:, None] * len(ORDERS) + order) * (STEPS + 1) + FIRST[mask]
        removed = np.bincount((where * 4 + label[:, None]).ravel(), minlength=len(names) * len(ORDERS) * (STEPS + 1) * 4).reshape(len(names), len(ORDERS), STEPS + 1, 4)
        for i, name in enumerate(names):
            old = held.get(name, (0, 0))
            held[name] = removed[i] + old[0], masks[i] + old[1]
        if len(held) > PARTS_HELD:
            yield from sent()
    yield from sent()


def masks_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails, as bits in the order of FILTERS."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    light = saved(texts.mapInArrow(judged, "doc_id long, part string, mask int, digest binary"), work_dir(spark, "audit-masks"))
    # a table, so that the join deals both sides anew and Spark can split the rows of a text of many copies
    first = saved(light.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), work_dir(spark, "audit-copies"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return light.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """FIGURES of every part, order and step. masks: as of masks_of; labels: doc_id, quality, toxic."""
    bits = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    bits = saved(bits, work_dir(masks.sparkSession, "audit-labels"))
    rows = masks.join(bits, "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in FIGURES)
    return rows.mapInArrow(counted, schema).groupBy("part", "filter_order", "step").agg(*(F.sum(x).alias(x) for x in FIGURES))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
words AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, f.first, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents d JOIN firsts f ON f.t = coalesce(d.text, '')),
marks AS (SELECT doc_id, max(quality = 1)::INT AS good, max(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN words.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY 1, 2),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS before FROM orders, range(1, 6) s(step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
    sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM met GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
