"""Line dedup by distinct-site spread.

Every non-blank line is hashed; for each hash a HyperLogLog sketch of the sites it occurs on is built on the map side
and merged by aggregation. Lines whose estimate is clearly over the threshold are boilerplate, clearly under are not;
those near the threshold get an exact distinct count first. Boilerplate lines are then taken out of every document.
A line of a third of all rows is no hot key: one sketch of it leaves each task.

`copies_once` (the pipeline's stage) counts each distinct text once, at the site of its least id: exact copies of a document do not
spread its lines, so a copied text stays for the near-duplicate stage. Without it (op6 and its SQL) every copy counts at
its own site, and a text that was copied to `min_sites` sites loses all its lines in every copy.

Defined cases: a null text stays null, an empty one empty; blank lines are kept and never counted. A null site is the
site ''. A document whose lines all go keeps its row with an empty text. Repeated rows and ties are treated alike.
All input columns are kept, in order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, saved, table, work_dir

MIN_SITES = 10
#: sketches have 2**LG_K registers; NEAR is six of their standard errors
LG_K = 10
NEAR = 6 * 1.04 / (2 ** (LG_K / 2))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def _lines_of_texts(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(line_hash, site) of each distinct text once, at the site of its least id."""
    full = F.filter(_lines(F.col(text)), lambda x: ~_blank(x))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(text).alias("text_hash"), F.struct(F.col(key).alias("id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site")).alias("place"),
        F.array_distinct(F.transform(full, lambda x: F.xxhash64(x))).alias("lines"),
    )
    # hashes only, and one row of a text leaves each task however often it was copied
    texts = rows.groupBy("text_hash").agg(F.min("place").alias("place"), F.any_value("lines").alias("lines"))
    texts = saved(texts.select("place.site", "lines"), f"{work_dir(docs.sparkSession, 'line-texts')}/texts")
    return texts.select(F.explode("lines").alias("line_hash"), "site")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", copies_of: str | None = None) -> DataFrame:
    """(line_hash) of the lines that occur on `min_sites` sites or more; with an id column `copies_of`, copies of a text count once."""
    if copies_of is not None:
        hashed = _lines_of_texts(docs, copies_of, text, site)
    else:
        one = docs.select(F.explode(_lines(F.col(text))).alias("line"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
        hashed = one.where(~_blank(F.col("line"))).select(F.xxhash64("line").alias("line_hash"), "site")
    estimated = hashed.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    over, under = min_sites * (1 + NEAR), min_sites * (1 - NEAR)
    # a table of its own: few lines come near the threshold, and the join below sees how few
    candidates = saved(estimated.where(F.col("sites") >= under), f"{work_dir(docs.sparkSession, 'line-sketches')}/candidates")
    near = candidates.where(F.col("sites") <= over).select("line_hash")
    exact = hashed.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count_distinct("site").alias("sites"))
    return candidates.where(F.col("sites") > over).select("line_hash").unionAll(exact.where(F.col("sites") >= min_sites).select("line_hash"))


@any_names
def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", copies_once: bool = False) -> DataFrame:
    """The documents without their boilerplate lines; the columns of the input."""
    # a table of its own: small enough to be sent to all tasks, or else joined with splits for lines of very many documents
    boilerplate = saved(spread_lines(docs, min_sites, text, site, key if copies_once else None), f"{work_dir(docs.sparkSession, 'line-dedup')}/boilerplate")
    # should two rows have one hash, each gets the boilerplate lines of both, which it may lose anyway
    row = F.xxhash64(F.col(key), F.col(text))
    places = docs.select(row.alias("__row"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x)))).alias("line_hash"))
    hit = places.join(boilerplate, "line_hash", "left_semi").groupBy("__row").agg(F.collect_set("line_hash").alias("__gone"))
    kept = F.filter(_lines(F.col(text)), lambda x: _blank(x) | ~F.array_contains(F.col("__gone"), F.xxhash64(x)))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    joined = docs.withColumn("__row", row).join(hit, "__row", "left")
    return joined.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_spread_lines(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, coalesce(source, '') AS site FROM documents),
b AS (SELECT line FROM l WHERE trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT coalesce(list(line), []) AS gone FROM b)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)), chr(10)) END AS text, lang, source, n_chars
FROM documents, m
"""
