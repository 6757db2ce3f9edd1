"""Quality rules: repetition and length, then perplexity bands of an n-gram model of the corpus itself.

Base rules count words, symbols, repeated lines and repeated word windows. The model is a modified Kneser-Ney model of
byte ORDER-grams (letters lower-cased, digits alike, runs of white space one blank), one for each language, counted by
Spark over all documents. Spark works out its probabilities and the weights that histories leave to shorter grams, and
writes them as sorted hash arrays: a folder for each range of the 64-bit hashes, of RANGE_GRAMS entries or so. A task
opens the ranges one after another for the grams of GROUP_BYTES of text at a time, so neither the driver nor a task
ever holds the model; there is this one path at every size, and the number of ranges changes no bit of the result. A
document whose perplexity is outside the band of its language, quartiles plus SPREAD interquartile ranges of the
language's documents, is rejected.

Defined cases: a null text counts as empty: no words, base_failed. A null language is a language of its own. A language
whose documents are all equal has a band around that value. Repeated rows count as often as they occur and get equal
results; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, row_chunks, saved, string_bytes, table, work_dir
from .token_shards import file_system

ORDER = 4
#: entries of a range of the hash arrays, and bytes of text that are looked up in each range at a time
RANGE_GRAMS, GROUP_BYTES = 8_000_000, 32 << 20
SPREAD = 6.0
MIN_WORDS, MAX_REPEATED = 50, 50
CHUNK = 1 << 20
COUNT_AT_ONCE = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[[9, 10, 11, 12, 13]] = 0x20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_BLANK = " \t\n\x0b\x0c\r"


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER-grams of the rows' bytes, a blank before and after each row, and their row numbers."""
    n = len(offsets) - 1
    # a blank in front of every row and one after the last; then runs of blanks within a row become one
    data = np.insert(_CLASS[raw], offsets, 0x20)
    row = np.repeat(np.arange(n), np.diff(offsets) + 1)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    fronts = offsets + np.arange(n + 1)
    keep[fronts[1:] - 1] &= data[fronts[1:] - 1] != 0x20  # a row's own last blank
    keep[fronts] = True
    data, row = data[keep], row[keep[:-1]]
    codes = np.zeros(max(0, len(row) - ORDER + 2), np.uint32)
    if not len(codes):
        return codes, codes.astype(np.int64)
    for i in range(ORDER):
        codes = (codes << np.uint32(8)) | data[i : i + len(codes)]
    # the last byte may be the blank in front of the next row, which is this row's end
    inside = row[: len(codes)] == row[ORDER - 2 : ORDER - 2 + len(codes)]
    return codes[inside], row[: len(codes)][inside]


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_bytes(pc.utf8_lower(pc.fill_null(column, "")))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): the ORDER-grams of all documents; each task sends a count for each gram that it has met."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(name: str) -> None:
            codes, counts = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            old = totals.get(name)
            if old is not None:
                both = np.concatenate([old[0], codes])
                order = np.argsort(both, kind="stable")
                both, number = both[order], np.concatenate([old[1], counts])[order]
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                codes, counts = both[first], np.add.reduceat(number, first)
            totals[name] = codes, counts

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False)
            names = langs.dictionary.to_pylist()
            raw, offsets = prepared(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                codes, row = grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own = number[a:b][row]
                for i in np.unique(number[a:b]):
                    held.setdefault(names[i], []).append(codes[own == i])
                    if sum(map(len, held[names[i]])) > COUNT_AT_ONCE:
                        settle(names[i])
        for name in list(held):
            settle(name)
        for name, (codes, counts) in totals.items():
            for i in range(0, len(codes), 100_000):
                part = codes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.astype(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_hash(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def entry_hash(kind: int, grams: np.ndarray, language: np.ndarray) -> np.ndarray:
    """What an entry is known by. kind: the order for probabilities, -order for weights of histories."""
    return mix(mix(grams.astype(np.uint64) | np.uint64((kind + ORDER) << 40)) ^ language)


class HashArray:
    """Values by 64-bit hash: hashes in sorted order, found from the pointer of their equal part of the hash range."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        # parts are equal pieces of what the hashes span
        first = int(self.hashes[0]) if len(hashes) else 0
        span = int(self.hashes[-1]) - first if len(hashes) else 0
        self.first, self.shift = np.uint64(first), np.uint64(max(0, span.bit_length() - max(1, len(hashes).bit_length())))
        self.pointers = np.searchsorted((self.hashes - self.first) >> self.shift, np.arange((span >> int(self.shift)) + 2, dtype=np.uint64)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if absent."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        open_ = np.flatnonzero((hashes >= self.first) & (hashes <= self.hashes[-1]))
        part = ((hashes[open_] - self.first) >> self.shift).astype(np.int64)
        at, end = self.pointers[part], self.pointers[part + 1]
        while len(open_):
            inside = at < end
            open_, at, end = open_[inside], at[inside], end[inside]
            hit = self.hashes[at] == hashes[open_]
            out[open_[hit]] = at[hit]
            open_, at, end = open_[~hit], at[~hit] + 1, end[~hit]
        return out


def discounts_of(ones: list[float]) -> list[float]:
    """What is taken off a count of 0, 1, 2, and 3 or more, from the numbers of grams that occur 1 to 4 times."""
    y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.5
    return [0.0] + [min(max(i - (i + 1) * y * ones[i] / ones[i - 1], 0.05), i * 0.95) if ones[i - 1] else 0.5 * i for i in (1, 2, 3)]


def model_entries(counts: DataFrame, work: str) -> DataFrame:
    """(kind, lang, gram, value) of (lang, gram, n): log2 of every probability, and of the weight of every history.

    Shorter grams are counted by the longer ones that end in them, as Kneser and Ney have it.
    """
    levels = {ORDER: counts.select("lang", "gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        shorter = (F.col("gram") % 2 ** (8 * order)).alias("gram")
        levels[order] = saved(levels[order + 1].groupBy("lang", shorter).agg(F.count("*").alias("n")), f"{work}/order-{order}")
    below, out = None, None
    for order in range(1, ORDER + 1):
        ones = levels[order].agg(*[F.coalesce(F.sum((F.col("n") == i).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        _, one, two, more = discounts_of(list(ones))
        taken = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        level = levels[order].select("lang", "gram", "n", taken.alias("taken"), F.shiftright("gram", 8).alias("history"), (F.col("gram") % 2 ** (8 * (order - 1))).alias("shorter"))
        groups = saved(level.groupBy("lang", "history").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("gamma")), f"{work}/histories-{order}")
        level = level.join(groups, ["lang", "history"])
        # every shorter gram was counted from the longer ones
        level = level.withColumn("below", F.lit(1 / 256)) if below is None else level.join(below, ["lang", "shorter"])
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * F.col("below")
        level = saved(level.select("lang", "gram", p.alias("p")), f"{work}/p-{order}")
        below = level.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
        entries = level.select(F.lit(order).alias("kind"), "lang", "gram", F.log2("p").alias("value"))
        entries = entries.unionAll(groups.select(F.lit(-order).alias("kind"), "lang", F.col("history").alias("gram"), F.log2("gamma").alias("value")))
        out = entries if out is None else out.unionAll(entries)
    return out


@dataclass(frozen=True)
class Model:
    """Where the hash arrays are; bits: the leading bits of a hash that name its range."""

    path: str
    bits: int


def train(counts: DataFrame, work: str, range_grams: int | None = None) -> Model:
    """Writes the model of (lang, gram, n) as hash arrays below work."""
    entries = model_entries(counts, work)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            own = np.array([language_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
            kinds, grams = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hashes = np.zeros(batch.num_rows, np.uint64)
            for kind in np.unique(kinds).tolist():
                at = kinds == kind
                hashes[at] = entry_hash(kind, grams[at], own[at])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(3).cast(pa.float32())], ["hash", "value"])

    rows = saved(entries.mapInArrow(hashed, "hash long, value float"), f"{work}/entries")
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / (range_grams or RANGE_GRAMS))))
    part = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    dealt = rows.withColumn("part", part).repartitionById(1 << bits, "part").sortWithinPartitions("part", unsigned)
    dealt.write.partitionBy("part").parquet(f"{work}/model")
    return Model(f"{work}/model", bits)


class Lookup:
    """Reads a model's ranges, one at a time; the last one stays open."""

    def __init__(self, model: Model):
        self.model, self.open = model, (-1, None)
        self.files, self.root = file_system(model.path)

    def range(self, part: int) -> HashArray:
        if self.open[0] != part:
            self.open = (-1, None)  # let go before the next is read
            folder = f"{self.root}/part={part}"
            there = self.files.get_file_info(folder).type.name == "Directory"
            found = pq.read_table(folder, filesystem=self.files, columns=["hash", "value"], partitioning=None) if there else pa.table({"hash": pa.array([], pa.int64()), "value": pa.array([], pa.float32())})
            self.open = (part, HashArray(found["hash"].to_numpy().view(np.uint64), found["value"].to_numpy()))
        return self.open[1]

    def values(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each hash."""
        out, known = np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool)
        parts = (hashes >> np.uint64(64 - self.model.bits)).astype(np.int64) if self.model.bits else np.zeros(len(hashes), np.int64)
        for part in np.unique(parts).tolist():
            mine = np.flatnonzero(parts == part)
            array = self.range(part)
            at = array.find(hashes[mine])
            hit = at >= 0
            out[mine[hit]], known[mine[hit]] = array.values[at[hit]], True
        return out, known

    def log2(self, grams: np.ndarray, language: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last byte of each gram after the others; language: the hash of each one's language."""
        out, open_ = np.zeros(len(grams), np.float32), np.arange(len(grams))
        grams = grams.astype(np.uint64)
        for order in range(ORDER, 0, -1):
            if not len(open_):
                return out
            mine, own = grams[open_] & np.uint64((1 << (8 * order)) - 1), language[open_]
            value, known = self.values(entry_hash(order, mine, own))
            out[open_] += value
            open_, mine, own = open_[~known], mine[~known], own[~known]
            weight, known = self.values(entry_hash(-order, mine >> np.uint64(8), own))
            out[open_] += weight  # nothing where the history is unknown too
        out[open_] += -8.0  # a byte never seen: uniform
        return out


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    raw, offsets = string_bytes(texts)
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for a, b in row_chunks(offsets, CHUNK):
        data, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

        def by_row(flags: np.ndarray, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[at[1:]] - sums[at[:-1]]

        out["word_chars"][a:b] = by_row(~_SPACE[data] & ((data & 0xC0) != 0x80))
        out["n_symbols"][a:b] = by_row(_SYMBOL[data])
        words = Words(data, at, lower=False)
        out["n_words"][a:b] = np.diff(words.first)
        hashes, whole = words.windows(3)
        where = np.flatnonzero(whole)
        if len(where):
            key = mix(hashes[where] + mix(words.row[where].astype(np.uint64)))
            _, own, times = np.unique(key, return_inverse=True, return_counts=True)
            covered = np.zeros(len(words.hash), bool)
            again = where[times[own] > 1]
            for i in range(3):
                covered[again + i] = True
            sums = np.concatenate([[0], np.cumsum(covered)])
            out["n_repeat_words"][a:b] = sums[words.first[1:]] - sums[words.first[:-1]]
        for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
            if text and "\n" in text:
                lines = text.split("\n")
                if len(set(lines)) < len(lines):
                    full = [x for x in lines if x.strip(_BLANK)]
                    out["n_dup_lines"][i] = len(full) - len(set(full))
    return out


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log2_perplexity double"


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, base counts, log2_perplexity: mean bits a byte, null without text)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))

    def bits_of(lookup: Lookup, batch: pa.RecordBatch) -> pa.Array:
        coded = batch.column(1).dictionary_encode()
        own = coded.indices.to_numpy().astype(np.uint64)
        languages = np.array([language_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)
        raw, offsets = prepared(batch.column(2))
        bits, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        held: list[tuple] = []

        def settle() -> None:
            """Looks up the grams of the chunks that are held, together."""
            values = lookup.log2(np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]))
            start = 0
            for a, b, found, _, row, place in held:
                bits[a:b] = np.bincount(row, values[start : start + len(found)].astype(np.float64)[place], minlength=b - a)
                size[a:b] = np.bincount(row, minlength=b - a)
                start += len(found)
            held.clear()

        total = 0
        for a, b in row_chunks(offsets, CHUNK):
            codes, row = grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            # equal grams of a chunk are looked up once
            found, place = np.unique((own[a:b][row] << np.uint64(32)) | codes, return_inverse=True)
            held.append((a, b, found & np.uint64(0xFFFFFFFF), languages[(found >> np.uint64(32)).astype(np.int64)], row.astype(np.int32), place.astype(np.int32)))
            total += int(offsets[b] - offsets[a])
            # with one range there is nothing to wait for
            if not model.bits or total >= GROUP_BYTES:
                settle()
                total = 0
        if held:
            settle()
        return pa.array(-bits / np.maximum(size, 1), mask=size == 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            counts = base_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(counts[k]) for k in NAMES], bits_of(lookup, batch)], ["doc_id", "lang", *NAMES, "log2_perplexity"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {kind}, lang string, {MEASURES}")


def judge(measured: DataFrame) -> DataFrame:
    """The measures with base_failed, the language's band and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    quartiles = measured.where(~failed).groupBy("lang").agg(F.percentile_approx("log2_perplexity", [0.25, 0.75], 10_000).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    slack = SPREAD * F.greatest(high - low, F.lit(0.01))
    bands = quartiles.select("lang", (low - slack).alias("band_low"), (high + slack).alias("band_high"))
    inside = F.col("log2_perplexity").between(F.col("band_low"), F.col("band_high"))
    return measured.withColumn("base_failed", failed).join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), work_dir(spark, "quality")
    model = train(saved(count_grams(docs), f"{work}/grams"), work)
    judged = judge(saved(measure(docs, model), f"{work}/measures"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log2_perplexity", 4).alias("bits_a_byte"))
