"""Language ID by nearest centroids.

A text becomes a vector of hashed byte n-grams (two and three bytes of its lower-cased UTF-8), weighted by log term
frequency and inverse document frequency and scaled to length one. Each language has several centroids, found by
spherical k-means; the nearest by cosine gives the prediction, and the cosine is the score. A text is rejected by its
distance: if its cosine is under MARGIN times what all but the share TAIL of training texts of that language and of its
length class reach. A class of few training texts asks for less.

The classifier is fitted on a sample of labelled texts, chosen by a hash of key and text: LANGUAGE_ROWS of a language at
most, or fewer if there are so many languages that all would hold more than SAMPLE_ROWS (but CLUSTERS of each at least).
Tasks turn the sampled texts, whole, into sparse vectors of FEATURES counts at most; one task fits. Everything else
covers all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is rejected. Rows with a null label or
key can be scored, never learned from (null key) or learned from (null label). Without labelled rows all is `und`.
Equal cosines go to the language that sorts first. Repeated rows get equal results; other columns stay out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import any_names, row_chunks, saved, string_bytes, table, work_dir

FEATURES = 1 << 13
CLUSTERS, ROUNDS = 4, 8
#: bounds of the fitting sample: in all, and for one language
SAMPLE_ROWS, LANGUAGE_ROWS = 3200, 800
#: length classes (bytes) of the rejection limits
LENGTHS = np.array([32, 64, 128, 256, 1024])
TAIL, MARGIN = 0.01, 0.75
#: training texts of a language and length class that make its limit count half
HALF_TRUST = 20
UNKNOWN = "und"
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: ASCII bytes other than letters count as blanks
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def count_ngrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x FEATURES counts of the rows' hashed two- and three-byte n-grams."""
    n, b = len(offsets) - 1, _LETTERS[raw].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    gap = (b[:-1] == 0x20) & (b[1:] == 0x20)  # between words at most one blank counts
    out = np.zeros(n * FEATURES, np.float32)
    codes = b
    for size in (2, 3):
        if len(b) < size:
            break
        codes = (codes[: len(b) - size + 1] << np.uint32(8)) | b[size - 1 :]
        inside = row[: len(codes)] == row[size - 1 :]
        for i in range(size - 1):
            inside &= ~gap[i : i + len(codes)]
        place = ((codes + np.uint32(size << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        at = row[: len(codes)] * FEATURES + place
        out += np.bincount(at[inside], minlength=len(out))
    return out.reshape(n, FEATURES)


def scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts weighted by idf, each row of length one."""
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def small_chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in row_chunks(offsets, BYTES_AT_ONCE):
        for i in range(a, b, ROWS_AT_ONCE):
            yield i, min(b, i + ROWS_AT_ONCE)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_bytes(pc.utf8_lower(pc.fill_null(column, "")))


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and each row's centroid."""
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(1)
        for c in range(k):
            if (mine := own == c).any():
                total = x[mine].sum(0)
                centers[c] = total / max(float(np.sqrt(total @ total)), 1e-9)
    return centers, (x @ centers.T).argmax(1)


class Centroids:
    """The fitted model: languages, idf, centroids with their languages, and the limits of acceptance."""

    def __init__(self, langs: list[str], sizes: np.ndarray, places: list[np.ndarray], counts: list[np.ndarray]):
        """langs: the language of each training text; sizes: its bytes; places and counts: its n-grams."""
        self.languages = sorted(set(langs))
        y = np.array([self.languages.index(x) for x in langs], np.int64)
        found = np.bincount(np.concatenate(places), minlength=FEATURES) if places else np.zeros(FEATURES)
        self.idf = np.log((1 + len(langs)) / (1 + found)).astype(np.float32) + 1
        rng, centers = np.random.default_rng(11), []
        #: accepted from this cosine on, by language and length class; a class never seen takes the limit of the next longer one
        self.limits = np.full((len(self.languages), len(LENGTHS) + 1), 1.0, np.float32)
        for i in range(len(self.languages)):  # the vectors of one language at a time
            rows = np.flatnonzero(y == i)
            x = np.zeros((len(rows), FEATURES), np.float32)
            for j, row in enumerate(rows):
                x[j, places[row]] = np.log1p(counts[row])
            x = scaled(x, self.idf)
            own, _ = spherical_kmeans(x, CLUSTERS, rng)
            centers.append(own)
            length, near = np.searchsorted(LENGTHS, sizes[rows], side="right"), (x @ own.T).max(1)
            for c in np.unique(length):
                mine = near[length == c]
                self.limits[i, c] = np.quantile(mine, TAIL) * len(mine) / (len(mine) + HALF_TRUST)
        self.centers = np.concatenate(centers) if centers else np.zeros((0, FEATURES), np.float32)
        self.owner = np.repeat(np.arange(len(centers)), [len(c) for c in centers]).astype(np.int64)
        # longer texts are nearer: a shorter class never asks for more than the longer ones
        self.limits = MARGIN * np.minimum.accumulate(self.limits[:, ::-1], axis=1)[:, ::-1]

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) of each row."""
        if not len(self.languages):
            n = len(offsets) - 1
            return np.full(n, -1), np.zeros(n, np.float32), np.ones(n, bool)
        cosine = scaled(np.log1p(count_ngrams(raw, offsets)), self.idf) @ self.centers.T
        best = cosine.argmax(1)
        lang, score = self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return lang, score, score < self.limits[lang, np.searchsorted(LENGTHS, np.diff(offsets), side="right")]


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(lang, mark, text): the fitting sample."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("language-id"), key, text).alias("mark"), F.col(text).cast("string").alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.agg(F.count("*").alias("languages"))  # one row
    bounds = counts.crossJoin(F.broadcast(languages)).select("lang", "n", F.least(F.lit(LANGUAGE_ROWS), F.greatest(F.lit(CLUSTERS), F.floor(SAMPLE_ROWS / F.col("languages")))).alias("bound"))
    # a table of its own, a row a language: Catalyst sees whether it is small enough to send to all tasks, and the texts stay where they are
    bounds = saved(bounds, f"{work_dir(labelled.sparkSession, 'language-id')}/bounds")
    # twice the share by hash, so that few rows are left to rank; then exactly the bound, whatever the ties
    wanted = F.pmod("mark", F.lit(1 << 30)) / (1 << 30) < 2 * F.col("bound") / F.col("n")
    found = rows.join(bounds, "lang").where(wanted & F.regexp_like("text", F.lit(r"\p{L}")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))
    return found.withColumn("place", place).where(F.col("place") <= F.col("bound")).select("lang", "mark", "text")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Centroids:
    """The model of a bounded sample, fitted by one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = lowered(batch.column(2))
            for a, b in small_chunks(offsets):
                x = count_ngrams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = [np.flatnonzero(row) for row in x]
                columns = [pa.array(np.diff(offsets[a : b + 1])), pa.array([p.astype(np.uint16).tobytes() for p in at]), pa.array([row[p].tobytes() for row, p in zip(x, at, strict=True)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["lang", "mark", "size", "places", "counts"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        places = [np.frombuffer(r[3], np.uint16).astype(np.int64) for r in rows]
        model = Centroids([r[0] for r in rows], np.array([r[2] for r in rows], np.int64), places, [np.frombuffer(r[4], np.float32) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    vectors = sample(labelled, text, lang, key).mapInArrow(count, "lang string, mark long, size long, places binary, counts binary")
    row = vectors.repartition(1).mapInArrow(train, "model binary").first()  # CLUSTERS x FEATURES floats a language
    return pickle.loads(row["model"]) if row else Centroids([], np.zeros(0, np.int64), [], [])


@any_names
def predict(docs: DataFrame, model: Centroids, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with lang_pred, score and rejected; input columns of these names are replaced."""
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS x FEATURES floats a language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            raw, offsets = lowered(texts)
            lang, score, rejected = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for a, b in small_chunks(offsets):
                lang[a:b], score[a:b], rejected[a:b] = model.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lang[~lettered], score[~lettered], rejected[~lettered] = -1, 0, True
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[lang], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*kept, *new])

    return rows.mapInArrow(task, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=["doc_id", "held_out"])


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).where(~F.col("rejected")).select(*docs.columns)
