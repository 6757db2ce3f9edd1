"""Media columns: telephony audio.

8-bit mu-law and A-law samples are expanded by lookup tables; IMA ADPCM blocks are decoded with numpy, one step for all
blocks of many files at a time; PCM is resampled by linear interpolation in integers. Both are WAV files: the telephony
form keeps its bytes as they came (formats 7, 6 and 17, 8 kHz, mono), PCM is 16-bit (format 1). Which of the three forms a
text is taken for is decided by its bytes alone.

Defined cases: a null payload counts as empty and is padded to one block of blanks; equal payloads give equal media and
features; very long ones are handled whole. Bytes that are not a WAV file of a known format give null on reading.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_chunks, saved, string_bytes, table, work_dir

PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
FORMS, NAMES = (MULAW, ALAW, IMA_ADPCM), {MULAW: "mulaw", ALAW: "alaw", IMA_ADPCM: "adpcm"}
RATE, BLOCK = 8000, 192
#: the rate of a short form of the samples that features are given of besides those of all samples
SHORT_RATE = 2000
CHUNK = 2 << 20
#: fixed values of the IMA ADPCM format: change of the step index for the low three bits of a code
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """The sample of each mu-law code: an inverted sign, 3-bit exponent and 4-bit mantissa over a bias of 33 (times 4)."""
    code = ~np.arange(256) & 0xFF
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = (((mantissa << 1) + 33) << exponent) - 33
    return (np.where(code & 0x80, -size, size) * 4).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The sample of each A-law code: even bits inverted, and a linear segment at the bottom."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: fixed values: the quantizer steps of IMA ADPCM
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample, and the next step index times 16, for each step index (times 16) and code together."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step, size = STEPS[index], code & 7
    change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
    return np.where(code & 8, -change, change).astype(np.int32), np.clip(index + INDEX_SHIFT[size], 0, len(STEPS) - 1).astype(np.int32) * 16


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
ADPCM_CHANGE, ADPCM_NEXT = adpcm_tables()


def decode_ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks (rows of bytes: 16-bit first sample, step index, a spare byte, then two codes a byte, low first)."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, len(blocks)), np.int16)
    out[0], sample = head, head
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * len(codes)):
        both = state + ((codes[i >> 1] >> (4 * (i & 1))) & 15)
        sample = np.clip(sample + ADPCM_CHANGE[both], -32768, 32767)
        out[i + 1], state = sample, ADPCM_NEXT[both]
    return out.T


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Linear interpolation at the ratio up/down, in integers, so the same on every machine."""
    if not len(pcm):
        return pcm.astype(np.int16)
    at = np.arange(len(pcm) * up // down, dtype=np.int64) * down
    left, part = at // up, at % up
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int32)
    return ((wide[left] * (up - part) + wide[right] * part) // up).astype(np.int16)


def wav(data: bytes, kind: int, rate: int = RATE, bits: int = 8, block: int | None = None) -> bytes:
    """A mono WAV file around the data, which stays as it is (a pad byte follows odd lengths)."""
    align = block or bits // 8
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * align, align, bits) + (b"" if kind == PCM else struct.pack("<H", 0))
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(format, rate, block align, data) of a mono WAV file; None for other bytes."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    view, at, form = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form and form[1] == 1:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def to_pcm(kind: int, data, align: int) -> np.ndarray | None:
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[raw]
    if kind == ALAW:
        return ALAW_TABLE[raw]
    if kind == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    if kind == IMA_ADPCM and align > 4:
        return decode_ima_blocks(raw[: len(raw) // align * align].reshape(-1, align)).reshape(-1)
    return None


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHUNK bytes of the binary column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in row_chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), CHUNK):
        yield batch.slice(a, b - a)


def decoded(media: list[bytes | None]) -> list[tuple[np.ndarray, int] | None]:
    """(samples, rate) of each WAV file; ADPCM blocks of one size are decoded together, whichever files they are of."""
    read = [read_wav(x) if x is not None else None for x in media]
    out: list[tuple[np.ndarray, int] | None] = [None] * len(media)
    by_align: dict[int, list[int]] = {}
    for i, found in enumerate(read):
        if found is None:
            continue
        kind, rate, align, data = found
        if kind == IMA_ADPCM and align > 4:
            by_align.setdefault(align, []).append(i)
        elif (pcm := to_pcm(kind, data, align)) is not None:
            out[i] = pcm, rate
    for align, files in by_align.items():
        raw = [np.frombuffer(read[i][3], np.uint8) for i in files]
        blocks = [x[: len(x) // align * align].reshape(-1, align) for x in raw]
        samples = decode_ima_blocks(np.concatenate(blocks))
        ends = np.cumsum([len(x) for x in blocks])
        for i, a, b in zip(files, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = samples[a:b].reshape(-1), read[i][1]
    return out


def form_of(payload: bytes) -> int:
    """The telephony form that a payload is taken for."""
    return FORMS[zlib.crc32(payload) % len(FORMS)]


def as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with blanks to whole blocks, as the data of a telephony WAV."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                sizes, media = [], []
                for i in range(a, b):
                    data = raw[offsets[i] : offsets[i + 1]].tobytes()
                    sizes.append(len(data))
                    payload = data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")
                    form = form_of(payload)
                    media.append(wav(payload, form, bits=4, block=BLOCK) if form == IMA_ADPCM else wav(payload, form))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media", rate: int = 16000) -> DataFrame:
    """The frame with `pcm`: a 16-bit PCM WAV of each media value at the wanted rate, null where it can't be read. An input column `pcm` is replaced."""
    kept = [c for c in media.columns if c != "pcm"]
    schema = media.select(*kept).withColumn("pcm", F.lit(None).cast("binary")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for part in _parts(batch, at):
                found = decoded(part.column(at).to_pylist())
                pcm = [None if x is None else wav(resample(x[0], rate, x[1]).astype("<i2").tobytes(), PCM, rate, 16) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary())], [*kept, "pcm"])

    return media.select(*kept).mapInArrow(task, schema)


def figures(pcm: np.ndarray, name: str = "") -> str:
    """Samples, loudness, peak, crossings of zero and checksum of 16-bit samples."""
    x = pcm.astype(np.int64)
    said = {"samples": len(x), "rms": math.isqrt(int((x * x).sum()) // max(len(x), 1)), "peak": int(np.abs(x).max(initial=0)), "zc": int(((x[:-1] < 0) != (x[1:] < 0)).sum()), "pcm": zlib.crc32(pcm.astype("<i2").tobytes())}
    return ";".join(f"{name}{k}={v}" for k, v in said.items())


def describe(media: DataFrame) -> DataFrame:
    """Digests of stored media (doc_id, n_bytes, media, pcm), and features of their PCM: form, figures of the samples at SHORT_RATE, and of all samples if the PCM has more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 3):
                stored = part.column(2).to_pylist()
                files = [read_wav(x) for x in stored]
                payloads = [f[3] for f in files]
                features = []
                for (kind, *_), (_, rate, _, data) in zip(files, map(read_wav, part.column(3).to_pylist()), strict=True):
                    pcm = np.frombuffer(data, "<i2")
                    every = f";rate={rate};{figures(pcm, 'all_')}" if rate > SHORT_RATE else ""
                    features.append(f"form={NAMES[kind]};{figures(resample(pcm, SHORT_RATE, rate))}{every}")
                columns = [part.column(0), part.column(1), pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads])]
                columns += [pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()), pa.array([len(x) for x in stored], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]), pa.array(features)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written as a table and read back; all their samples are decoded at the operator's own rate."""
    return describe(decode_media(saved(as_media(table(spark, sf_dir, "documents")), work_dir(spark, "telephony"))))
