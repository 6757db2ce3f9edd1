"""Token-id shards: raw id payloads, with a minimal perfect hash from document keys to their places.

A shard is two files. `shard-N.ids` holds the ids of its documents one after another, little-endian, unsigned 16 bits
(32 if the vocabulary needs it). `shard-N.mph` holds the documents' keys and offsets in order, and an index: levels of
bit arrays in which each distinct key owns exactly one bit, whose rank among all bits is the key's slot; a slot stores a
32-bit fingerprint of its key and the document's position. A lookup reads one bit a level and one slot, whatever the
size of the shard. `manifest` (Parquet) has a row per shard.

Documents are dealt by key range, as many ranges as keep a shard at SHARD_BYTES of text, so shards are in ascending key
order over the whole set. Payloads are read by range, of READ_IDS ids or one document, never whole. Files are written under a
name of their own attempt and then renamed, so a task that runs again replaces its shard by an equal one.

Defined cases: a null text counts as empty, so its payload is the end id alone. Documents with a null key come first;
they have offsets but no slot. Of repeated keys all documents are stored, ordered by hash and text, and the slot points
to the first. An empty table writes no shard. Columns other than key and text are not stored.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, row_chunks, saved, sent_to_tasks, string_bytes, table, work_dir
from .spans import LETTER, SpanCache, classes, code_points, encode_texts, gather, well_known

END_ID = 0
#: pieces that a Python worker keeps, and bytes of text encoded at a time
CACHE_PIECES, ENCODE_BYTES = 1_000_000, 1 << 20
#: bytes of text of a shard, and ids that are read from one at a time
SHARD_BYTES, READ_IDS = 256 << 20, 1 << 21


class PieceEncoder:
    """encode(text).ids of a byte-level tokenizer file, which encodes each distinct piece of its pre-tokenizer once."""

    def __init__(self, path: str, dtype: str = "<u2"):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # one character stands for one byte
        self.cache = SpanCache(self._new, [self.dtype], CACHE_PIECES)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the pieces. Runs of letters, each after a blank or a line break, are encoded side by side as one text and told apart by their bytes."""
        codes, stops = code_points("".join(pieces)), np.cumsum([0, *map(len, pieces)])
        kinds, width = classes()[codes], np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        blank = codes[stops[:-1]] == 32
        alone = ~blank & (kinds[stops[:-1]] == LETTER)
        word = (blank | alone) & (kinds[stops[1:] - 1] == LETTER)
        words, others = np.flatnonzero(word), np.flatnonzero(~word).tolist()
        bare = alone[words]  # a line break goes in front of these
        found, sizes = [np.zeros(0, self.dtype)], np.zeros(len(pieces), np.int64)
        for at in range(0, len(words), 4000):
            own = words[at : at + 4000]
            text = "".join([pieces[i] if has else "\n" + pieces[i] for i, has in zip(own.tolist(), (~bare[at : at + 4000]).tolist(), strict=True)])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.diff(width[stops])[own] + bare[at : at + 4000])) + 1
            keep = np.ones(len(ids), bool)
            keep[np.concatenate([[0], ends[:-1]])[bare[at : at + 4000]]] = False
            sizes[own] = np.diff(ends, prepend=0) - bare[at : at + 4000]
            found.append(ids[keep])
        rest = self._whole([pieces[i] for i in others])
        sizes[others] = [len(x) for x in rest]
        flat = np.concatenate([*found, *rest])
        first = np.zeros(len(pieces), np.int64)
        order = np.concatenate([words, np.array(others, np.int64)])
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return [(gather(flat, first, sizes)[0], sizes)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self.special and self.special.search(t) or not well_known(t)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        found = encode_texts(self.cache, plain, blank_in_front=True, single_digits=False)[0]
        for i in odd:
            found[i] = self._whole([texts[i]])[0]
        return found


@lru_cache(1)
def _loaded(path: str, dtype: str) -> PieceEncoder:
    """One encoder for each Python worker: its pieces serve all tasks that the worker runs."""
    return PieceEncoder(path, dtype)


# ---- the index ----


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5F00D5EED1234)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, one slot each, by levels of bit arrays; other keys go anywhere or to -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts, self.ranks, before = [], [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(64, -(-2 * len(keys) // 64) * 64)
            at = _place(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(keys[open_], level, len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[level][word] + below)[hit]
            open_ = open_[~hit]
        return out


class Shard:
    """A shard's keys, offsets (in ids) and index."""

    def __init__(self, nulls: int, keys: np.ndarray, offsets: np.ndarray, hashed: PerfectHash, marks: np.ndarray, positions: np.ndarray):
        self.nulls, self.keys, self.offsets, self.hashed, self.marks, self.positions = nulls, keys, offsets, hashed, marks, positions

    @classmethod
    def of(cls, nulls: int, keys: np.ndarray, offsets: np.ndarray) -> Shard:
        distinct, first = np.unique(keys, return_index=True)
        raw = distinct.view(np.uint64)
        hashed = PerfectHash.of(raw)
        marks, positions = np.zeros(len(raw), np.uint32), np.zeros(len(raw), np.uint32)
        slots = hashed.slots(raw)
        marks[slots], positions[slots] = fingerprint(raw), first + nulls
        return cls(nulls, keys, offsets, hashed, marks, positions)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of the first document of each key, -1 where the fingerprint says that the key is not here."""
        raw = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slots = self.hashed.slots(raw)
        out = np.full(len(raw), -1, np.int64)
        there = np.flatnonzero(slots >= 0)
        there = there[self.marks[slots[there]] == fingerprint(raw[there])]
        out[there] = self.positions[slots[there]]
        return out

    def to_bytes(self) -> bytes:
        with io.BytesIO() as out:
            np.savez(out, nulls=np.int64(self.nulls), keys=self.keys, offsets=self.offsets, marks=self.marks, positions=self.positions, **{f"level{i}": x for i, x in enumerate(self.hashed.levels)})
            return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as x:
            levels = [x[f"level{i}"] for i in range(sum(k.startswith("level") for k in x.files))]
            return cls(int(x["nulls"]), x["keys"], x["offsets"], PerfectHash(levels), x["marks"], x["positions"])


# ---- files ----


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _write(path: str, name: str, data) -> None:
    fs, root = file_system(path)
    own = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for part in data:
            out.write(part)
    fs.move(own, f"{root}/{name}")


def _read(path: str, name: str) -> bytes:
    fs, root = file_system(path)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


class Payload:
    """A shard's ids, read by range."""

    def __init__(self, path: str, shard: int, dtype: str):
        fs, root = file_system(path)
        self.file, self.dtype, self.width = fs.open_input_file(f"{root}/shard-{shard:07d}.ids"), dtype, np.dtype(dtype).itemsize

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), self.dtype)

    def close(self) -> None:
        self.file.close()


MANIFEST = "shard int, n_docs long, n_ids long, first_key long, last_key long"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Encode and write every document; the manifest. `path` must be in a folder that all executors share."""
    spark = docs.sparkSession
    dtype = "<u4" if wide else "<u2"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # equal rows are told apart by their place, so that any number of them is dealt over several ranges
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shards, "key", "tie", "place").sortWithinPartitions("key", "tie", "text").select("key", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _loaded(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        keys, lengths, nulls = [], [], 0

        def payloads():
            nonlocal nulls
            for batch in batches:
                column = batch.column(0)
                nulls += column.null_count
                keys.append(column.drop_null().to_numpy(zero_copy_only=False))
                _, offsets = string_bytes(batch.column(1))
                for a, b in row_chunks(offsets, ENCODE_BYTES):
                    for ids in encoder.encode(batch.column(1).slice(a, b - a).to_pylist()):
                        lengths.append(len(ids) + 1)
                        yield ids.tobytes() + end

        first = next(parts := payloads(), None)
        if first is None:
            return
        name = f"shard-{shard:07d}"
        _write(path, f"{name}.ids", (x for more in ([first], parts) for x in more))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        found = np.concatenate(keys).astype(np.int64)
        _write(path, f"{name}.mph", [Shard.of(nulls, found, offsets).to_bytes()])
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "n_docs": [len(lengths)], "n_ids": [int(offsets[-1])], "first_key": pa.array([int(found[0]) if len(found) else None], pa.int64()), "last_key": pa.array([int(found[-1]) if len(found) else None], pa.int64())}
        )

    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    dealt.mapInArrow(task, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, each found through its shard's index and read from its payload."""
    dtype = "<u4" if wide else "<u2"
    # a row per shard: few enough for one running sum
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = read_manifest(spark, path).withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("shard", "base")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = Shard.from_bytes(_read(path, f"shard-{shard:07d}.mph"))
                payload = Payload(path, shard, dtype)
                first = np.arange(len(index.keys)) - np.searchsorted(index.keys, index.keys)  # place among equal keys
                at = np.concatenate([np.arange(index.nulls), index.find(index.keys) + first])
                start, end = index.offsets[at], index.offsets[at + 1]
                keys = pa.concat_arrays([pa.nulls(index.nulls, pa.int64()), pa.array(index.keys, pa.int64())])
                # documents lie in the order of their keys, so a run of them is one range of the payload
                for a, b in row_chunks(np.concatenate([[0], np.cumsum(end - start)]), READ_IDS):
                    low = int(start[a:b].min())
                    ids = payload.ids(low, int(end[a:b].max()))
                    crc = [zlib.crc32(ids[x - low : y - low].astype("<u4").tobytes()) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(base + start[a:b]), pa.array((end - start)[a:b]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                payload.close()

    parts = max(1, manifest.count())
    return manifest.repartition(parts).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, path: str, key: str = "doc_id", wide: bool = False) -> DataFrame:
    """(doc_id, ids) of each distinct wanted key that is stored: routed to its shard by range, found by the index."""
    spark, dtype = keys.sparkSession, "<u4" if wide else "<u2"
    # the bounds of the shards, 20 bytes for each SHARD_BYTES of text
    bounds = read_manifest(spark, path).where("first_key is not null").select("shard", "first_key", "last_key").orderBy("shard").toArrow()
    shards, firsts, lasts = (bounds[x].to_numpy() for x in ("shard", "first_key", "last_key"))
    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, firsts, lasts = shared.value
        for batch in batches:
            asked = batch.column(0).to_numpy()
            # of a key whose documents straddle two shards the first document is in the lower one
            at = np.minimum(np.searchsorted(lasts, asked), len(lasts) - 1)
            there = np.flatnonzero((firsts[at] <= asked) & (asked <= lasts[at])) if len(lasts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shards[at[there]], pa.int32()), pa.array(asked[there])], ["shard", "doc_id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, payload = -1, None, None
        for batch in batches:
            shards, wanted_keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for shard in np.unique(shards).tolist():
                if shard != last:
                    last, index, payload = shard, Shard.from_bytes(_read(path, f"shard-{shard:07d}.mph")), Payload(path, shard, dtype)
                mine = wanted_keys[shards == shard]
                at = index.find(mine)
                mine, at = mine[at >= 0], at[at >= 0]
                sizes = np.concatenate([[0], np.cumsum(index.offsets[at + 1] - index.offsets[at])])
                for a, b in row_chunks(sizes, READ_IDS):
                    rows = [payload.ids(index.offsets[i], index.offsets[i + 1]).astype(np.int32) for i in at[a:b].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[a:b], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    with sent_to_tasks(spark, (shards, firsts, lasts)) as shared:
        routed = saved(wanted.mapInArrow(route, "shard int, doc_id long"), work_dir(spark, "token-routes"))
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(task, "doc_id long, ids array<int>")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
