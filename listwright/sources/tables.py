"""Scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import beginning


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all tasks by their keys. Small rows that are much work each come from few bytes, which one task would read and keep."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 1) -> DataFrame:
    """A relational table, read in ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def seed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry) of a seed file: a JSON array of objects as variants, so that absent keys and nulls stay apart; other content fails."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.try_variant_get(F.parse_json("value"), "$", "array<variant>"), F.raise_error(F.lit("a seed file is a JSON array")).cast("array<variant>"))
    return raw.select(F.posexplode(listed).alias("place", "entry"))


def seed_value(entry: str, key: str, kind: str = "string"):
    """The value of a key; null if absent or null."""
    return F.try_variant_get(F.col(entry), f"$.{key}", kind)


def has_key(entry: str, key: str):
    """Whether the object has the key at all, with any value."""
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(F.col(entry), "$", "map<string,variant>")), key), F.lit(False))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    schema = "job_categories array<struct<id:string,name:string,description:string>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("job_categories").alias("c")).select("c.*")


PROBE = T.StructType([T.StructField(n, t) for n, t in (("company_id", T.LongType()), ("company_name", T.StringType()), ("url", T.StringType()), ("final_url", T.StringType()), ("status", T.IntegerType()), ("html", T.StringType()), ("links", T.ArrayType(T.StringType())), ("json_endpoints", T.ArrayType(T.StringType())), ("job_link_count", T.IntegerType()), ("error", T.StringType()))])


def page_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON page probes; broken files are dropped, the file's name is kept."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(PROBE).json(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name")).where("company_id is not null")


def write_probes(probes: DataFrame, folder: str) -> int:
    """Adds the probes of companies that the folder has none of yet, a file each; their number."""
    spark = probes.sparkSession
    try:
        known = page_cache(spark, folder).select("company_id").distinct()
    except AnalysisException:  # no folder yet
        known = spark.createDataFrame([], "company_id long")
    new = probes.select(*[f.name for f in PROBE.fields]).where("company_id is not null").dropDuplicates(["company_id"]).join(known, "company_id", "left_anti").persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(folder)
        return n
    finally:
        new.unpersist()


def terms(spark: SparkSession, path: str) -> DataFrame:
    """One term a line; blank lines and `#` comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' and not term like '#%'")


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled titles of an evaluation set: (title, description, acceptable)."""
    schema = "title string, description string, acceptable array<string>"
    return spark.read.schema(schema).json(path, multiLine=True).where("title is not null")


def flat_records(rows: DataFrame, **provenance: str) -> DataFrame:
    """(record) JSON texts of the rows with all their columns and where they came from; NaN counts as null, and nulls are kept."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*plain, *[F.lit(v).alias(k) for k, v in provenance.items()]), {"ignoreNullFields": "false"}).alias("record"))


#: characters that the text of a document must and may have
PDF_TEXT = (200, 20_000)


def document_text(text: Column, limits: tuple[int, int | None] = PDF_TEXT) -> Column:
    """Extracted text of a document with white space tidied, cut at the upper limit if there is one; null under the lower one."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"[ \t\x{A0}]+", " "), r" ?\n ?", "\n")
    tidy = F.btrim(F.regexp_replace(tidy, r"\n{3,}", "\n\n"), F.lit(" \n"))
    return F.when(F.length(tidy) >= limits[0], beginning(tidy, limits[1]))
