"""Seed documents: loading, keyed upserts, export, validation, clean-ups."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def matched_by_name_or_slug(entries: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """Entries with the id of their company: by name, else by the name's slug among manual companies; null for new ones.

    Of entries of one name the first (`place`) counts.
    """
    keyed = entries.withColumn("__key", name_key(F.col(name)))
    one = keyed.groupBy("__key").agg(F.min_by(F.struct(*entries.columns), "place").alias("r")).select("__key", "r.*", slugify(F.col(f"r.{name}")).alias("__slug"))
    by_name = companies.groupBy(name_key(F.col("name")).alias("__key")).agg(F.min("id").alias("__by_name"))
    by_slug = companies.where("source = 'manual'").groupBy(F.col("slug").alias("__slug")).agg(F.min("id").alias("__by_slug"))
    return one.join(by_name, "__key", "left").join(by_slug, "__slug", "left").select(*entries.columns, F.coalesce("__by_name", "__by_slug").alias("id"))


def load(entries: DataFrame, companies: DataFrame, columns: Sequence[str], derived: Mapping[str, tuple[str, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """Companies after a seed: (id, name, slug, source, columns, derived columns, action).

    derived: columns that follow from another one, as {name: (from, how)}; worked out anew where that one changed and the
    entry doesn't have the column itself, and for new companies that come without it.

    entries: place, name, the columns, and `present`, the names of the keys that the entry has at all. A key that is
    absent leaves its column alone, one that is null clears it. Manual companies are protected: nothing of theirs
    changes. New names are inserted with a null id.
    """
    found = matched_by_name_or_slug(entries, companies)
    known = found.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*columns, "present"), "place").alias("e"))
    both = companies.join(known, "id", "left")
    writable = F.col("e").isNotNull() & (F.col("source") != "manual")
    taken = {c: F.when(writable & F.array_contains("e.present", c), F.col(f"e.{c}")).otherwise(F.col(c)) for c in columns}
    for name, (of, how) in (derived or {}).items():
        own = taken.get(name, F.col(name))
        said = F.array_contains("e.present", name) if name in columns else F.lit(False)
        taken[name] = F.when(writable & ~said & ~taken[of].eqNullSafe(F.col(of)), how(taken[of])).otherwise(own)
    new = [v.alias(c) for c, v in taken.items()]
    action = F.when(F.col("e").isNull(), "keep").when(writable, "update").otherwise("protected")
    stored = both.select("id", "name", "slug", "source", *new, action.alias("action"))
    fresh = found.where("id is null").select(F.lit(None).cast("long").alias("id"), "name", slugify(F.col("name")).alias("slug"), F.lit("seed").alias("source"), *[F.coalesce(F.col(c) if c in columns else F.lit(None), derived[c][1](F.col(derived[c][0]))).alias(c) if derived and c in derived else F.col(c) for c in taken], F.lit("insert").alias("action"))
    return stored.unionByName(fresh)


def upsert(entries: DataFrame, changes: DataFrame, name: str = "name", was: str = "was") -> DataFrame:
    """Entries after changes: one of the changed name or of its name before replaces them; others stay. Of changes to one name the last (`place`) counts."""
    last = changes.groupBy(name_key(F.col(name)).alias("__key")).agg(F.max_by(F.struct(*[c for c in changes.columns]), "place").alias("r")).select("r.*")
    touched = last.select(name_key(F.col(name)).alias("__key")).union(last.where(F.col(was).isNotNull()).select(name_key(F.col(was)))).distinct()
    kept = entries.withColumn("__key", name_key(F.col(name))).join(touched, "__key", "left_anti").select(*entries.columns)
    return kept.unionByName(last.select(*entries.columns))


def remove(entries: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    gone = names.select(name_key(F.col(name)).alias("__key")).distinct()
    return entries.withColumn("__key", name_key(F.col(name))).join(gone, "__key", "left_anti").select(*entries.columns)


def write(entries: DataFrame, path: str, name: str = "name") -> None:
    """Entries as JSON lines in the order of their names; the committer replaces the folder as a whole."""
    entries.repartitionByRange(name_key(F.col(name))).sortWithinPartitions(name_key(F.col(name)), name).write.mode("overwrite").json(path)


class SeedFile:
    """Entries that several writers change: under a lock, a change reads the newest version and writes the next as a whole.

    The folder is on a file system that all writers mount, since the lock is a file that only one can make. A version
    counts once its mark is there, so a writer that dies leaves the one before.
    """

    def __init__(self, path: str, wait: float = 60.0):
        self.path, self.wait = path.removeprefix("file://"), wait

    @contextmanager
    def _locked(self) -> Iterator[None]:
        os.makedirs(self.path, exist_ok=True)
        lock, until = f"{self.path}/lock", time.monotonic() + self.wait
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{lock} is held; remove it if its writer is gone") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            os.unlink(lock)

    def _newest(self, spark: SparkSession) -> int:
        return spark.read.schema("value string, version int").text(f"file://{self.path}/done").agg(F.max("version")).first()[0]

    def _put(self, entries: DataFrame, version: int) -> int:
        spark = entries.sparkSession
        entries.orderBy(name_key(F.col("name")), "name").write.mode("overwrite").parquet(f"file://{self.path}/entries/version={version}")
        spark.createDataFrame([("done",)], "value string").coalesce(1).write.text(f"file://{self.path}/done/version={version}")
        return version

    def _entries(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"file://{self.path}/entries/version={version}")

    def create(self, entries: DataFrame) -> None:
        with self._locked():
            self._put(entries, 0)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._entries(spark, self._newest(spark))

    def _change(self, spark: SparkSession, change: Callable[[DataFrame], DataFrame]) -> int:
        with self._locked():
            at = self._newest(spark)
            return self._put(change(self._entries(spark, at)), at + 1)

    def sync(self, changes: DataFrame) -> int:
        """Puts entries in, or in place of those of their names; the new version."""
        return self._change(changes.sparkSession, lambda old: upsert(old, changes))

    def forget(self, names: DataFrame) -> int:
        return self._change(names.sparkSession, lambda old: remove(old, names))


def entry_json(columns: Sequence[str]) -> Column:
    """A sparse object in a fixed order of keys: null, false and empty values are left out."""

    def some(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(~F.coalesce(text, F.lit("")).isin("", "false", "[]"), F.col(c)).alias(c)

    return F.to_json(F.struct(*[some(c) for c in columns]))


def validate(entries: DataFrame, required: Sequence[str], allowed: Sequence[str], enums: dict[str, Sequence[str]], name: str = "name", place: str = "place", keys: str = "keys") -> DataFrame:
    """(place, level, message): what is wrong with each entry of a seed file.

    entries: place, the columns named, and `keys`, all keys of the object. Errors are missing, unexpected and unknown
    values and names met twice; a name that is not after the one before it is a warning.
    """
    rows = entries.select(place, *{name, *required, *enums}, keys)

    def found(condition: Column, level: str, message: Column) -> DataFrame:
        return rows.where(F.coalesce(condition, F.lit(False))).select(place, F.lit(level).alias("level"), message.alias("message"))

    out = [found(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", "error", F.lit(f"missing {c}")) for c in required]
    strange = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
    out.append(found(F.size(strange) > 0, "error", F.concat(F.lit("unexpected "), F.array_join(F.array_sort(strange), ","))))
    out += [found(~F.col(c).isin(*values), "error", F.concat(F.lit(f"unknown {c} "), F.col(c))) for c, values in enums.items()]
    low = rows.select(place, name_key(F.col(name)).alias("low"))
    twice = low.groupBy("low").agg(F.count("*").alias("n"), F.min(place).alias("__first")).where("n > 1")
    out.append(low.join(twice, "low").where(F.col(place) != F.col("__first")).select(place, F.lit("error").alias("level"), F.concat(F.lit("duplicate "), "low").alias("message")))
    before = low.select((F.col(place) + 1).alias(place), F.col("low").alias("before"))
    out.append(low.join(before, place).where("low < before").select(place, F.lit("warning").alias("level"), F.concat(F.lit("out of order "), "low").alias("message")))
    found_all = out[0]
    for more in out[1:]:
        found_all = found_all.unionByName(more)
    return found_all


def verified_share(rows: DataFrame, category: str, verified: str) -> DataFrame:
    """(category, total, verified, percent)."""
    counted = rows.groupBy(category).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(verified), F.lit(False))).alias("verified"))
    return counted.withColumn("percent", F.round(100 * F.col("verified") / F.col("total"), 1))


def merge_results(base: DataFrame, *layers: DataFrame, key: str = "name", columns: Sequence[str] = ("url",)) -> DataFrame:
    """The base with the columns of the layers: the last layer that has a value wins, and `origin` says which (0 is the base)."""
    out = base.withColumn("origin", F.lit(0))
    for i, layer in enumerate(layers, 1):
        new = layer.groupBy(key).agg(*[F.min(c).alias(f"__{c}") for c in columns])
        both = out.join(new, key, "left")
        hit = F.coalesce(*[F.col(f"__{c}") for c in columns]).isNotNull()
        out = both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns], F.when(hit, i).otherwise(F.col("origin")).alias("origin"))
    return out


#: words that tell a product or a branch from its brand
PRODUCT_WORDS = ("pro", "studio", "series", "edition", "labs", "audio", "records", "europe", "usa", "international")


def brand_root(name: Column, words: Sequence[str] = PRODUCT_WORDS) -> Column:
    """The name without brackets, legal endings and words of products at its end."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), r"[^\p{L}\p{N}]+", " "))
    return F.trim(F.regexp_replace(plain, rf"(?:\s+(?:inc|llc|ltd|gmbh|corp|co|{'|'.join(words)}))+$", ""))


def has_parent(rows: DataFrame, url: str, name: str) -> DataFrame:
    """The rows with `has_parent`: whether another name at the same URL is a beginning of theirs, word by word.

    Names are joined with the beginnings of the others at their URL, so no group is paired with itself.
    """
    words = F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " ")
    named = rows.select(url, name, F.array_join(words, " ").alias("__low"), words.alias("__words"))
    starts = named.select(url, name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__words") - 1, F.lit(1))), lambda i: F.array_join(F.slice("__words", 1, i), " "))).alias("__start"), "__low").where("__start <> __low")
    known = named.select(url, F.col("__low").alias("__start")).distinct()
    found = starts.join(known, [url, "__start"], "left_semi").select(url, name).distinct().withColumn("__has", F.lit(True))
    return rows.join(found, [url, name], "left").select(*rows.columns, F.coalesce("__has", F.lit(False)).alias("has_parent"))
