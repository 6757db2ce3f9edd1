"""Periodic runs of words: stretches in which the same few words come round again and again.

A run is a stretch with smallest period q, MIN_EXPONENT periods and MIN_LENGTH words long at least, that can't be made
longer on either side. They are found by a scan of all lags: the array of word ids is compared with itself shifted by
q = 1, 2, ... up to a MIN_EXPONENT-th of its length, and true stretches are measured by run length. Texts of one chunk
stand in one array, the longest first, with ids of their own, so that one comparison serves all that are long enough for
a lag. From lag 5 on a stretch that counts covers eight aligned truths, which are tested as one 64-bit number; a stretch
is kept if no q / prime is a period of it too (with four periods or more any smaller period divides q).

The work is quadratic in a text's length, so long texts are not one task's: above LONG_BYTES they are written, cut into
up to MOST_UNITS ranges of lags of equal length, and dealt over all tasks as (document, lag range); a document's runs
are gathered by its place in that table.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text. Rows without a doc_id and rows
that are repeated get their own results each. An empty table gives an empty result. Other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, row_chunks, saved, string_bytes, table, work_dir

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: bytes of a text beyond which its lags are dealt out, in the square of the times that it is longer, MOST_UNITS ranges at most
LONG_BYTES = 48_000
MOST_UNITS = 64

_ALL = np.uint64(0x0101010101010101)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start: long, length: long, period: long>>"


def primes_of(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def true_stretches(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Ends of the longest stretches of truths that are `least` long at least."""
    n = len(same)
    if least < 15:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                yield s, e
        return
    whole = np.flatnonzero(same[: n // 8 * 8].view(np.uint64) == _ALL)
    if not len(whole):
        return
    cut = np.flatnonzero(np.diff(whole) != 1)
    for a, b in zip(whole[np.concatenate([[0], cut + 1])].tolist(), whole[np.concatenate([cut, [len(whole) - 1]])].tolist(), strict=True):
        if b - a + 1 >= (least - 7) // 8:
            s, e = a * 8, b * 8 + 8
            while s and same[s - 1]:
                s -= 1
            while e < n and same[e]:
                e += 1
            if e - s >= least:
                yield s, e


def scan(ids: np.ndarray, ends: np.ndarray, exponent: int, least: int, part: int = 0, parts: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, length, period) of the runs. ids: of all documents, the longest first, no id in two of them;
    ends: one past each document's last word. part of parts: the range of lags that is looked at."""
    lengths = np.diff(ends, prepend=0)
    most = int(lengths[0]) // exponent if len(lengths) else 0
    room = np.empty(len(ids) + 8, bool)
    for q in range(1 + most * part // parts, 1 + most * (part + 1) // parts):
        enough = max(least, exponent * q)
        docs = int(np.searchsorted(-lengths, -enough, side="right"))
        if not docs:
            return
        end = int(ends[docs - 1])
        same = np.equal(ids[: end - q], ids[q:end], out=room[: end - q])
        for s, e in true_stretches(same, enough - q):
            e += q
            if not any(np.array_equal(ids[s : e - q // p], ids[s + q // p : e]) for p in primes_of(q)):
                doc = int(np.searchsorted(ends, s, side="right"))
                yield doc, s - int(ends[doc - 1] if doc else 0), e - s, q


def runs_of(raw: np.ndarray, offsets: np.ndarray, exponent: int, least: int, part: int = 0, parts: int = 1) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each row, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for a, b in row_chunks(offsets):
        words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False)
        count = np.diff(words.first)
        order = np.argsort(-count, kind="stable")
        ids = pd.factorize(words.hash ^ mix(words.row.astype(np.uint64)))[0].astype(np.int32)
        sequence = np.concatenate([ids[words.first[i] : words.first[i + 1]] for i in order.tolist()])
        for doc, *run in scan(sequence, np.cumsum(count[order]), exponent, least, part, parts):
            out[a + int(order[doc])].append(tuple(run))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(text: bytes, runs: list) -> bytes:
    """The text's words, joined by one space, without those that a run repeats."""
    words = text.split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _as_arrow(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], _RUNS)


def _collapsed_column(raw: np.ndarray, offsets: np.ndarray, runs: list) -> pa.Array:
    data, at = raw.tobytes(), offsets.tolist()
    return pa.array([collapsed(data[i:j], r) for i, j, r in zip(at[:-1], at[1:], runs, strict=True)], pa.binary()).cast(pa.string())


def find_runs(docs: DataFrame, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, runs, collapsed): each document's runs by start and period, and its text without their repetitions."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > long_bytes
    out = rows.select("doc_id", F.lit(0).alias("x")).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {out}, runs {_RUNS_SQL}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column(1))
            runs = runs_of(raw, offsets, exponent, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_arrow(runs), _collapsed_column(raw, offsets, runs)], ["doc_id", "runs", "collapsed"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, offsets = string_bytes(batch.column(3).slice(i, 1))
                runs = runs_of(raw, offsets, exponent, least, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                if runs[0]:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), _as_arrow(runs)], ["place", "runs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column(1))
            runs = [sorted(((x["start"], x["length"], x["period"]) for x in r or ()), key=lambda x: (x[0], x[2])) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_arrow(runs), _collapsed_column(raw, offsets, runs)], ["doc_id", "runs", "collapsed"])

    short = rows.where(~is_long).mapInArrow(whole, schema)
    kept = saved(rows.where(is_long).withColumn("place", F.monotonically_increasing_id()), work_dir(spark, "runs-long"))
    times = F.octet_length("text") / F.lit(float(long_bytes))
    units = F.least(F.lit(MOST_UNITS), F.ceil(times * times)).cast("int")
    dealt = kept.select("place", units.alias("parts"), "text").select("place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "text").repartition("place", "part")
    found = dealt.mapInArrow(ranges, f"place long, runs {_RUNS_SQL}").groupBy("place").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return short.unionByName(kept.join(found, "place", "left").select("doc_id", "text", "runs").mapInArrow(gathered, schema))


def looped(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words with a loop put in for every tenth document, as the query's contract has it."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def loop_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        put = [i for i, x in enumerate(ids) if x is not None and zlib.crc32(str(x).encode()) % 10 == 0 and texts[i].is_valid]
        if put:
            all_texts = texts.to_pylist()
            for i in put:
                all_texts[i] = b" ".join(looped(all_texts[i].encode().split(), ids[i])).decode()
            texts = pa.array(all_texts, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])


def greatest(runs: str) -> Column:
    """The run of the greatest exact length / period; the first by start, then period, among equal ones."""
    return F.expr(f"aggregate({runs}, {runs}[0], (best, x) -> if(x.length * best.period > best.length * x.period, x, best))")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without doc_id gets no loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(loop_words, "doc_id long, text string")
    found = find_runs(docs).withColumn("best", F.when(F.size("runs") > 0, greatest("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
