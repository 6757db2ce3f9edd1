"""What the operators of this folder share: tables, the shared work folder, numpy over Arrow strings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named by spark.checkpoint.dir.

    Where a session on one machine names none, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="listwright-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """The frame written to path and read back: lineage is cut, each row is computed once."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sent_to_tasks(spark: SparkSession, value) -> Iterator[Broadcast]:
    """The value as a broadcast that is taken back at the end; jobs that need it must have run by then."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def any_names(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For steps on frames whose own columns begin with two underscores: the caller's columns of such names are kept, too."""

    @wraps(step)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        away = {c: f"kept-{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not away:
            return step(docs, *args, **kwargs)
        return step(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


# ---- numpy over the UTF-8 bytes of an Arrow string column ----

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
CHUNK_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        for name, base in (("_POWERS", _R), ("_INVERSES", inverse)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            globals()[name] = np.multiply.accumulate(row)
    return _POWERS, _INVERSES


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Runs of rows of about `size` bytes; a longer row stands alone, whole."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows of a chunk: byte spans, row numbers and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        data = _LOWER[raw] if lower else raw
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        inside = ~space
        self.start = np.flatnonzero(inside & (before | first[:-1]))
        after = np.ones(len(data), bool)
        after[:-1] = space[1:]
        self.end = np.flatnonzero(inside & (after | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        powers, inverses = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverses[self.start])
        #: the first word of each row, and one past the last row's last
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place (garbage where fewer follow in its row), and whether k do follow."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        whole = np.zeros(n, bool)
        m = n - k + 1
        for i in range(k):
            out[:m] = (out[:m] + self.hash[i : i + m]) * np.uint64(0xD6E8FEB86659FD93)
        whole[:m] = self.row[:m] == self.row[k - 1 :]
        return mix(out), whole


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int):
    """Per row the sorted distinct hashes of its k-word shingles (ASCII case ignored); a shorter text is one shingle."""
    for a, b in row_chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        words = Words(raw[offsets[a] : offsets[b]], at, lower=True)
        hashes, whole = words.windows(k)
        for row in range(b - a):
            i, j = words.first[row], words.first[row + 1]
            if j - i >= k:
                yield np.unique(hashes[i : j - k + 1])
            elif j > i:
                h = np.array([j - i], np.uint64)
                for x in words.hash[i:j]:
                    h = mix(h * np.uint64(31) + x)
                yield h
            else:
                yield np.zeros(0, np.uint64)
