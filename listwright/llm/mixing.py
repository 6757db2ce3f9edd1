"""Mixing sources to target weights by Poisson replication.

A source of n documents that should hold the share w of a mix as large as the corpus gets the mean repetition rate
w * total / n. Each document draws its count from a Poisson distribution of that mean, inverted at a uniform number
hashed from (seed, key, text), is exploded that many times, and the copies are ordered over all partitions by another
hash, of `order_key` and the row's number, so that equal rows are spread too.
Sources without a stated weight share what the stated ones leave, in proportion to their documents. A rate over
MAX_RATE is the sum of equal parts, each drawn by its own number, since a sum of Poisson counts is one.

Defined cases: a null source counts as the source ''. A null key or text is hashed as ''. Repeated rows (equal key and
text) draw the same count. An empty table gives an empty result; a stated weight of an absent source is ignored and the
others keep their rates. All input columns are kept as they are; the added ones (`copy`, `n_copies`, `order_key`)
replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, saved, table, work_dir

WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.10, "src3": 0.02}
SEED = 17
#: exp(-rate) must stay a normal number
MAX_RATE = 500.0
#: a source's rows meet its rate in so many groups, so that a source of a third of all rows is no hot key
SALTS = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    zero = F.exp(-rate)
    start = F.struct(F.array(zero).alias("c"), zero.alias("p"), zero.alias("s"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        s = acc["s"] + p
        return F.struct(F.concat(acc["c"], F.array(s)).alias("c"), p.alias("p"), s.alias("s"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def repetition_rates(docs: DataFrame, weights: dict[str, float], source: str = "source") -> DataFrame:
    """(source key, rate, parts, cdf of a part) for each source, from the counts of all rows."""
    if sum(weights.values()) > 1 or min(weights.values(), default=0) < 0:
        raise ValueError("weights are shares of the mix: none below 0, 1 together at most")
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source")).agg(F.count("*").alias("n"))
    stated = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("__source")) if weights else F.lit(None).cast("double")
    rows = counts.withColumn("w", stated)
    totals = rows.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("w").isNull(), F.col("n"))).alias("free"))  # one row
    left = 1.0 - sum(weights.values())
    rate = F.when(F.col("w").isNotNull(), F.col("w") * F.col("total") / F.col("n")).otherwise(F.lit(left) * F.col("total") / F.col("free"))
    rates = rows.crossJoin(F.broadcast(totals)).select("__source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int"))
    return rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


@any_names
def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document as often as its Poisson count says, in an order that is random over the whole result."""
    rates = repetition_rates(docs, weights, source).select("__source", F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    # a table of its own, a row per source, so that Catalyst sees whether it is small enough to send to all tasks; the texts then stay where they are
    rates = saved(rates, f"{work_dir(docs.sparkSession, 'mixing')}/rates").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("copy", "n_copies", "order_key")]
    rows = docs.select(*kept, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("string")).alias("__text"), F.monotonically_increasing_id().alias("__n"))
    rows = rows.withColumn("__salt", F.pmod("__n", F.lit(SALTS)).cast("int"))
    drawn = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda i: uniform(F.lit(str(seed)), name, F.col("__text"), F.when(i > 0, i.cast("string"))))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    counted = rows.join(rates, ["__source", "__salt"]).withColumn("n_copies", count)
    copies = counted.where(F.col("n_copies") > 0).select(*kept, "__text", "__n", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    ordered = copies.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), name, F.col("__text"), F.col("copy"))))
    # equal rows have equal keys: their numbers send them to places of their own
    return ordered.orderBy(F.xxhash64("order_key", "__n"), "order_key").drop("__text", "__n")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, CASE s WHEN 'src0' THEN 0.15::DOUBLE WHEN 'src1' THEN 0.08::DOUBLE WHEN 'src2' THEN 0.10::DOUBLE WHEN 'src3' THEN 0.02::DOUBLE END AS w FROM c),
t AS (SELECT sum(n)::DOUBLE AS total, (sum(n) FILTER (WHERE w IS NULL))::DOUBLE AS free FROM w),
q AS (SELECT s, CASE WHEN w IS NOT NULL THEN w * total / n ELSE (1.0::DOUBLE - (0.15::DOUBLE + 0.08::DOUBLE + 0.10::DOUBLE + 0.02::DOUBLE)) * total / free END AS rate FROM w, t),
o AS (SELECT s, rate, greatest(1, ceil(rate / 500.0::DOUBLE))::INTEGER AS parts FROM q),
r AS (SELECT s, rate / parts AS rate FROM o),
cdf AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS f FROM r
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), f + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
l AS (SELECT s, list(f ORDER BY k) AS f FROM cdf GROUP BY s),
d AS (SELECT documents.*, list_transform(range(parts), lambda i: ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), CASE WHEN i > 0 THEN i::VARCHAR END)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS us
  FROM documents JOIN o ON coalesce(documents.source, '') = o.s),
n AS (SELECT d.* EXCLUDE (us), list_sum(list_transform(us, lambda u: len(list_filter(f, lambda x: x <= u))))::INTEGER AS n_copies FROM d JOIN l ON coalesce(d.source, '') = l.s)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy::INTEGER AS copy, md5(concat_ws('|', 'order17', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), copy::VARCHAR)) AS order_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
"""
