"""Registered queries of the listings engine on the driver's tables, with the SQL that must answer alike.

customer stands for companies, orders for postings of a company, part for titles, events for the fetch log, documents
for descriptions and pages for fetched pages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import country, salary, search, text, url
from ..operators import board, health, history, lifecycle, pages, resolve, scoring
from ..sources.tables import table
from ..sources.work import work_dir
from ..streaming import log

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = date(1998, 1, 1)


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TITLE = "concat(CASE p_size % 7 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Trainee ' WHEN 3 THEN 'Head of ' WHEN 4 THEN 'Principal ' ELSE '' END, p_name, CASE p_size % 5 WHEN 0 THEN ' (full-time)' WHEN 1 THEN ' - part time' WHEN 2 THEN ' contractor' ELSE '' END)"


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
  WHERE o_orderstatus IN ('F', 'O') AND (nullif(o_totalprice, 0) IS NULL OR o_totalprice >= 50000) AND o_totalprice <= 250000),
t AS (SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM f)
SELECT f.*, total, pages FROM (SELECT * FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25) f, t""")
def board_filter_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the newest postings of two kinds whose price range meets the wanted one."""
    price = c("o_totalprice")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    rows = rows.where(c("o_orderstatus").isin("F", "O") & board.overlaps(price, F.nullif(price, F.lit(0)), 50_000, 250_000))
    return board.page(rows, [c("o_orderdate").desc(), c("o_orderkey").asc()], 2, 25)


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR nullif(o_custkey % 10, 0) IS NULL
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 1000)""")
def listable_existence(spark: SparkSession, d: str) -> DataFrame:
    poor = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), (c("c_acctbal") < 1000).alias("fresh"))
    rows = table(spark, d, "orders").join(poor, "o_custkey", "left")
    return rows.where((c("o_orderstatus") == "P") | (c("o_custkey") % 10 == 0) | F.coalesce("fresh", F.lit(False))).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F'
  AND (nullif(o_orderkey % 3, 0) IS NULL OR CAST(o_orderdate AS DATE) + 30 >= DATE '1998-01-01') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12""")
def featured_topk(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(c("o_orderstatus") == "F", c("o_orderdate"))
    until = F.when(c("o_orderkey") % 3 != 0, F.date_add(c("o_orderdate").cast("date"), 30))
    rows = table(spark, d, "orders").where(board.featured(at, until, AS_OF))
    return board.first_by(rows, [c("o_orderdate").desc(), c("o_orderkey").desc()], 12).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT p_partkey, p_name, p_type, CASE WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])red($|[^a-z0-9])') AND regexp_matches(p_name, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') THEN 0 ELSE 1 END AS rank FROM part
  WHERE (regexp_matches(p_name, '(?i)(^|[^a-z0-9])red($|[^a-z0-9])') OR regexp_matches(p_type, '(?i)(^|[^a-z0-9])red($|[^a-z0-9])') OR regexp_matches(p_brand, '(?i)(^|[^a-z0-9])red($|[^a-z0-9])'))
  AND (regexp_matches(p_name, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') OR regexp_matches(p_type, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') OR regexp_matches(p_brand, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])'))""")
def keyword_search_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where(search.matches(" Red, bolt! ", [c("p_name"), c("p_type")], [c("p_brand")]))
    return rows.select("p_partkey", "p_name", "p_type", search.rank("red bolt", [c("p_name")]).alias("rank"))


@query("""WITH f AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS kind, o_orderdate FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority IN ('1-URGENT', '2-HIGH')),
t AS (SELECT count(kind) AS total, CAST(ceil(count(*) / 40.0) AS BIGINT) AS pages FROM f)
SELECT f.*, total, pages FROM (SELECT * FROM f ORDER BY kind IS NULL, o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 40) f, t""")
def untyped_tail_paging(spark: SparkSession, d: str) -> DataFrame:
    """Rows of unknown kind come last; the total leaves them out and the page count does not."""
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("kind"), "o_orderdate")
    rows = rows.where(c("kind").isNull() | c("kind").isin("1-URGENT", "2-HIGH"))
    return board.page(rows, [c("kind").isNull().asc(), c("o_orderdate").desc(), c("o_orderkey").asc()], 2, 40, c("kind").isNull())


@query("""SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['bolt', 'red'])""")
def category_overlap(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("bolt"), F.lit("red"))
    return table(spark, d, "part").where(F.arrays_overlap(F.split("p_name", " "), wanted)).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_name ILIKE '%00012%')""")
def parent_substring(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").where(c("c_name").ilike("%00012%")).select(c("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(named, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, c_name, coalesce(n, 0) AS postings, coalesce(u, 0) AS urgent FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY postings DESC, c_name LIMIT 200""")
def child_counts_sorted(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "customer").select("c_custkey", "c_name")
    children = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counted = board.child_counts(parents, children, "c_custkey", postings=F.lit(True), urgent=c("o_orderpriority") == "1-URGENT")
    return board.first_by(counted, [c("postings").desc(), c("c_name").asc()], 200)


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS companies, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_postings FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Companies and open postings by category; postings are counted for each company before the join, so nothing fans out."""
    children = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counted = board.child_counts(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), children, "c_custkey", opened=c("o_orderstatus") == "O")
    return counted.groupBy("c_mktsegment").agg(F.count("*").alias("companies"), F.sum("opened").alias("open_postings"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def hiring_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(c("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def blocked_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_acctbal > 0").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH w AS (SELECT DISTINCT lower(n_name) AS value FROM nation UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part)
SELECT value, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT unnest(string_split(p_name, ' ')) AS value, count(*) AS n FROM part GROUP BY 1) USING (value)""")
def unnest_category_counts(spark: SparkSession, d: str) -> DataFrame:
    tagged = table(spark, d, "part").select(F.split("p_name", " ").alias("tags"))
    known = table(spark, d, "nation").select(F.lower("n_name").alias("value")).union(tagged.select(F.explode("tags"))).distinct()
    return board.array_counts(tagged, "tags", known)


@query("""SELECT n_nationkey AS code, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS code FROM customer) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON code = n_nationkey GROUP BY 1""")
def code_counts_unknown(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").where("n_nationkey < 20")
    return board.code_counts(table(spark, d, "customer").select(F.nullif("c_nationkey", F.lit(3)).alias("code_")), "code_", known, "n_nationkey")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_totalprice > 100000) AS on_board, count(DISTINCT o_custkey) AS companies, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_success FROM orders""")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    """All figures in one pass; companies are grouped first, so the distinct count is spread over all tasks."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "O").alias("a"), F.count_if(c("o_totalprice") > 100000).alias("b"), F.max(F.when(c("o_orderstatus") == "F", c("o_orderdate"))).alias("l"))
    return per.agg(F.sum("n").alias("total"), F.sum("a").alias("active"), F.sum("b").alias("on_board"), F.count("o_custkey").alias("companies"), F.max("l").alias("last_success"))


@query("""SELECT coalesce(nullif(event_type, 'click'), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1""")
def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("unknown"))
    return table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type"])


@query("""WITH r AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS other FROM events)
SELECT user_id, count(*) FILTER (WHERE other = 0) AS failures FROM r GROUP BY user_id""")
def leading_run(spark: SparkSession, d: str) -> DataFrame:
    return history.leading_run(table(spark, d, "events"), "user_id", ["ts", "event_id"], c("event_type") == "error", "failures")


HEALTH_SQL = """
WITH d AS (SELECT source, doc_id % 150 AS user_id, length(trim(text)) >= 200 AS described, lang = 'en' AS on_board, doc_id % 4 = 0 AS role FROM documents),
s AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE described) / count(*), 2) ELSE 0.0 END AS described_share,
  round(count(*) FILTER (WHERE role) / count(*), 2) AS role_share, count(*) FILTER (WHERE on_board) AS on_board FROM d GROUP BY 1),
e AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT e.user_id, coalesce(n, 0) AS active_rows, coalesce(described_share, 0) AS described_share, coalesce(role_share, 0) AS role_share, coalesce(on_board, 0) AS board_rows,
 CASE WHEN e.user_id % 11 = 0 THEN 'unscraped' WHEN event_type = 'error' THEN 'failing' WHEN coalesce(n, 0) = 0 THEN 'silent'
  WHEN n >= 3 AND described_share = 0 AND role_share < 0.25 THEN 'furniture' WHEN n >= 3 AND described_share < 0.2 THEN 'thin' WHEN on_board = 0 THEN 'idle' ELSE 'healthy' END AS grade
FROM e LEFT JOIN s USING (user_id)"""


@query(HEALTH_SQL)
def health_grades(spark: SparkSession, d: str) -> DataFrame:
    """Each company's shares and grade, from its descriptions and its latest fetch."""
    docs = table(spark, d, "documents").select((c("doc_id") % 150).alias("user_id"), (F.length(F.trim("text")) >= 200).alias("described"), (c("lang") == "en").alias("listed"), (c("doc_id") % 4 == 0).alias("role"))
    shares = docs.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("described").alias("d"), F.count_if("role").alias("r"), F.count_if("listed").alias("b"))
    last = history.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    rows = last.join(shares, "user_id", "left").fillna(0, ["n", "d", "r", "b"])
    rows = rows.select("user_id", c("n").alias("active_rows"), health.share(c("d"), c("n")).alias("described_share"), health.share(c("r"), c("n")).alias("role_share"), c("b").alias("board_rows"), F.when(c("event_type") == "error", "failed").otherwise("success").alias("status"))
    return rows.withColumn("grade", health.grade(c("active_rows"), c("described_share"), c("role_share"), c("board_rows"), c("status"), c("user_id") % 11 != 0)).drop("status")


@query(f"""WITH g AS ({HEALTH_SQL}), r AS (SELECT unnest(['failing', 'silent', 'furniture', 'thin', 'idle', 'healthy', 'unscraped']) AS grade, unnest(range(7))::INTEGER AS place)
SELECT grade, place, count(user_id) AS n FROM r LEFT JOIN g USING (grade) GROUP BY ALL""")
def grade_summary(spark: SparkSession, d: str) -> DataFrame:
    """Companies in each grade, in the fixed order of grades, 0 where there are none."""
    grades = spark.createDataFrame([(g, i) for i, g in enumerate(health.GRADES)], "grade string, place int")
    return board.child_counts(grades, health_grades(spark, d), "grade", n=F.lit(True))


@query("""WITH t AS (SELECT CASE WHEN p_size % 9 = 0 THEN 'Browse ' || p_name WHEN p_size % 9 = 1 THEN p_name || ' jobs' WHEN p_size % 9 = 2 THEN p_name || ' engineer' WHEN p_size % 9 = 3 THEN 'Privacy policy' WHEN p_size % 9 = 4 THEN '12' ELSE p_name END AS t, p_brand FROM part),
l AS (SELECT p_brand, CASE WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'unreviewable' WHEN t LIKE 'Browse %' OR t LIKE '% jobs' THEN 'navigation' WHEN t = 'Privacy policy' THEN 'boilerplate' WHEN t LIKE '% engineer' THEN 'job_shaped' ELSE 'unclear' END AS l FROM t)
SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE l = 'navigation') AS navigation, count(*) FILTER (WHERE l = 'boilerplate') AS boilerplate, count(*) FILTER (WHERE l = 'unreviewable') AS unreviewable, count(*) FILTER (WHERE l = 'job_shaped') AS job_shaped, count(*) FILTER (WHERE l = 'unclear') AS unclear FROM l GROUP BY 1""")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr("CASE WHEN p_size % 9 = 0 THEN concat('Browse ', p_name) WHEN p_size % 9 = 1 THEN concat(p_name, ' jobs') WHEN p_size % 9 = 2 THEN concat(p_name, ' engineer') WHEN p_size % 9 = 3 THEN 'Privacy policy' WHEN p_size % 9 = 4 THEN '12' ELSE p_name END")
    return health.class_histogram(table(spark, d, "part"), "p_brand", text.title_class(title), ("navigation", "boilerplate", "unreviewable", "job_shaped", "unclear"))


@query("""SELECT source, count(*) AS total, round(count(*) FILTER (WHERE lang = 'en') / count(*), 2) AS share FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'en') / count(*) >= 0.5""")
def share_having(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(c("lang") == "en").alias("part"))
    return counted.where(c("part") / c("total") >= 0.5).select("source", "total", health.share(c("part"), c("total")).alias("share"))


@query("""WITH u AS (SELECT page_id % 7 AS company, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')) AS host, url, length(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)) AS len FROM pages),
h AS (SELECT company, host, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT company, host, n FROM h QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, host) = 1),
l AS (SELECT company, host, url, count(*) AS k, min(len) AS len FROM u GROUP BY ALL)
SELECT company, host, n, url FROM b JOIN l USING (company, host) QUALIFY row_number() OVER (PARTITION BY company ORDER BY len, k DESC, url) = 1""")
def mode_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select((c("page_id") % 7).alias("company"), url.host_of(c("url")).alias("host"), "url")
    return health.mode_with_lead(rows, "company", "host", "url", F.length(url.path_and_query(c("url"))))


@query("""SELECT page_id, CASE WHEN regexp_matches(rest, '(?i)accessdenied|/error|404|page-not-found|buy-domain|domain_profile|press-releases?|/newsroom|\\.pdf$|/password\\b|aspxerrorpath') THEN 'bad_page' WHEN page_id % 5 = 0 THEN 'ats_board'
 WHEN regexp_matches(rest, '(?i)career|job|vacan|recruit|join|hiring|hire|employment|people|talent') OR regexp_matches(host, '(?i)career|job|vacan|recruit|join|hiring|hire|employment|people|talent') THEN 'careers_shaped' ELSE 'not_careers' END AS shape,
 rtrim(split_part(lower(trim(url)), '#', 1), '/') AS identity FROM (SELECT *, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS rest, regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS host FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'example', 'lever.co.example') WHEN page_id % 5 = 1 THEN replace(url, '/en/', '/Careers/') ELSE url END AS url FROM pages))""")
def url_shapes(spark: SparkSession, d: str) -> DataFrame:
    link = F.expr("CASE WHEN page_id % 5 = 0 THEN replace(url, 'example', 'lever.co.example') WHEN page_id % 5 = 1 THEN replace(url, '/en/', '/Careers/') ELSE url END")
    return table(spark, d, "pages").select("page_id", url.url_shape(link).alias("shape"), url.identity(link).alias("identity"))


@query(f"""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'senior' WHEN 1 THEN 'entry' WHEN 2 THEN 'internship' WHEN 3 THEN 'manager' WHEN 4 THEN 'lead' ELSE 'mid' END AS seniority,
  CASE p_size % 5 WHEN 0 THEN 'full-time' WHEN 1 THEN 'part-time' WHEN 2 THEN 'contract' END AS job_type, trim(regexp_replace(lower({TITLE}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def title_cascade(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr(TITLE)
    return table(spark, d, "part").select("p_partkey", text.seniority(title).alias("seniority"), text.job_type(title).alias("job_type"), text.slugify(title).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN n WHEN k = 1 THEN n WHEN k = 2 AND n >= 10000 THEN n WHEN k = 3 THEN 30 * 2080 END AS low, CASE WHEN k = 0 THEN n + 5000 WHEN k = 2 AND n >= 10000 THEN n + 5000 END AS high,
  CASE WHEN k = 0 THEN 'USD' WHEN k = 1 THEN 'GBP' WHEN k = 3 THEN 'EUR' END AS currency FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 10000 + o_custkey % 90000 AS n FROM orders)""")
def salary_ranges(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("CASE k WHEN 0 THEN concat('Pay $', n, ' - $', n + 5000, ' a year') WHEN 1 THEN concat('from £', n) WHEN 2 THEN concat(n, ' to ', n + 5000) WHEN 3 THEN '€30 per hour' ELSE 'competitive' END")
    rows = table(spark, d, "orders").select("o_orderkey", (c("o_orderkey") % 5).alias("k"), (10000 + c("o_custkey") % 90000).alias("n"))
    return salary.with_salary(rows.select("o_orderkey", said.alias("said")), "said", "low", "high", "currency").drop("said")


RECONCILE_SQL = """
WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS price, o_orderdate AS posted, o_orderstatus <> 'F' AS is_active, CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 17 = 0 THEN false END AS ov FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT o_custkey, o_orderkey, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS posted FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 4 <> 0),
r AS (SELECT c_custkey AS o_custkey, c_custkey % 9 = 0 AS trust, c_custkey % 6 <> 0 AS allow FROM customer WHERE c_custkey % 7 <> 0),
n AS (SELECT o_custkey, count(*) AS n FROM f GROUP BY 1),
m AS (SELECT coalesce(x.o_custkey, f.o_custkey) AS o_custkey, coalesce(x.o_orderkey, f.o_orderkey) AS o_orderkey, x.o_orderkey IS NOT NULL AS stored, f.o_orderkey IS NOT NULL AS seen, x.price AS p0, f.price AS p1, x.posted AS d0, f.posted AS d1, coalesce(is_active, false) AS was, ov
  FROM x FULL JOIN f ON x.o_custkey = f.o_custkey AND x.o_orderkey = f.o_orderkey),
s AS (SELECT m.*, r.allow AND (r.trust OR coalesce(n.n, 0) > 0) AS can FROM m LEFT JOIN r USING (o_custkey) LEFT JOIN n USING (o_custkey))
SELECT o_custkey, o_orderkey, CASE WHEN seen THEN p1 ELSE p0 END AS price, CASE WHEN seen THEN coalesce(d1, d0) ELSE d0 END AS posted, ov,
 CASE WHEN seen AND NOT stored THEN true WHEN seen AND NOT was AND coalesce(ov, true) THEN true WHEN NOT seen AND was AND coalesce(can, false) AND NOT coalesce(ov, false) THEN false ELSE was END AS is_active,
 CASE WHEN seen AND NOT stored THEN 'insert' WHEN seen AND NOT was AND coalesce(ov, true) THEN 'reactivate' WHEN seen THEN 'update' WHEN was AND coalesce(can, false) AND NOT coalesce(ov, false) THEN 'deactivate' ELSE 'keep' END AS action,
 NOT seen AND was AND NOT coalesce(can, true) AS skipped FROM s"""


@query(RECONCILE_SQL)
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings after a fetch of most companies."""
    orders = table(spark, d, "orders")
    override = F.when(c("o_orderkey") % 13 == 0, True).when(c("o_orderkey") % 17 == 0, False)
    stored = orders.where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", c("o_totalprice").alias("price"), c("o_orderdate").alias("posted"), (c("o_orderstatus") != "F").alias("is_active"), override.alias("ov"))
    fetched = orders.where("o_orderkey % 5 <> 0 and o_custkey % 4 <> 0").select("o_custkey", "o_orderkey", (c("o_totalprice") + 1).alias("price"), F.when(c("o_orderkey") % 2 == 0, c("o_orderdate")).alias("posted"))
    outcomes = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(c("c_custkey").alias("o_custkey"), (c("c_custkey") % 9 == 0).alias("trust_empty"), (c("c_custkey") % 6 != 0).alias("allow_deactivation"))
    return lifecycle.reconcile(stored, fetched, outcomes, ["o_custkey", "o_orderkey"], ["price", "posted"], ["posted"], override="ov")


@query(f"""WITH m AS ({RECONCILE_SQL}) SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action IN ('update', 'reactivate')) AS updated, count(*) FILTER (WHERE action = 'reactivate') AS reactivated, count(*) FILTER (WHERE action = 'deactivate') AS deactivated, count(*) FILTER (WHERE skipped) AS skipped FROM m""")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reconcile_counts(reconcile(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) + 60 < DATE '1998-01-01' THEN coalesce(CASE WHEN o_orderkey % 13 = 0 THEN true END, false) ELSE o_orderstatus <> 'F' END AS is_active FROM orders""")
def expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (c("o_orderstatus") != "F").alias("is_active"), F.when(c("o_orderkey") % 13 == 0, True).alias("is_active_override"), F.date_add(c("o_orderdate").cast("date"), 60).alias("expires_date"))
    return lifecycle.expire(rows, AS_OF).select("o_orderkey", "is_active")


@query("""WITH a AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN nullif(c_mktsegment, 'BUILDING') ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 9 <> 0)
SELECT * FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'deleted' WHEN a.c_name IS DISTINCT FROM b.c_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'changed' END AS change,
 CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN 'c_name' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) END AS fields FROM a FULL JOIN b ON a.c_custkey = b.c_custkey) WHERE change IS NOT NULL""")
def seed_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    after = rows.where("c_custkey % 9 <> 0").withColumns({"c_name": F.when(c("c_custkey") % 7 == 0, F.lower("c_name")).otherwise(c("c_name")), "c_mktsegment": F.when(c("c_custkey") % 5 == 0, F.nullif("c_mktsegment", F.lit("BUILDING"))).otherwise(c("c_mktsegment"))})
    return lifecycle.keyed_diff(rows.where("c_custkey % 10 <> 0"), after, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("""SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "orders").where("o_orderstatus = 'O'").select(c("o_custkey").alias("c_custkey"))
    jobs, log = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return lifecycle.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), seed, "c_custkey", orders=jobs, events=log)


@query("""SELECT s_nationkey, s_suppkey % 20 AS slot, s_name, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 20) - 1 AS shared_with, min(s_name) OVER (PARTITION BY s_nationkey, s_suppkey % 20) AS first_holder FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 20) > 1""")
def shared_bindings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_nationkey", (c("s_suppkey") % 20).alias("slot"), "s_name")
    return lifecycle.shared_bindings(rows, ["s_nationkey", "slot"], "s_name")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n, count(*) AS total, list_slice(list_sort(list(DISTINCT event_id) FILTER (WHERE event_type = 'error')), 1, 3) AS examples FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') > 0""")
def bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    return health.bucket_summary(table(spark, d, "events"), "user_id", "event_type", "error", "event_id")


@query("""SELECT event_id, CASE WHEN status IS NULL THEN 'error' WHEN status BETWEEN 200 AND 299 THEN CASE WHEN event_id % 3 = 0 THEN 'wrong_content' ELSE 'ok' END WHEN status IN (401, 403, 405, 406, 429, 999) THEN 'bot_defence' WHEN status IN (404, 410) THEN 'broken' WHEN status BETWEEN 500 AND 599 THEN 'server_error' ELSE 'other_status' END AS bucket
FROM (SELECT event_id, CAST(list_extract([200, 204, 301, 403, 404, 429, 500, NULL], CAST(event_id % 8 AS INT) + 1) AS INT) AS status FROM events)""")
def link_buckets(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 301, 403, 404, 429, 500)], F.lit(None).cast("int")), (c("event_id") % 8 + 1).cast("int"))
    kind = F.when(c("event_id") % 3 == 0, "image/png").otherwise("text/html")
    return table(spark, d, "events").select("event_id", url.link_bucket(status, F.lit("example.com"), kind).alias("bucket"))


@query("""WITH x AS (SELECT string_split(p_name, ' ') AS p, [string_split(p_name, ' ')[1], CASE WHEN p_size % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE 'none' END] AS a FROM part)
SELECT count(*) AS total, count(*) FILTER (WHERE len(p) > 0) AS covered, count(*) FILTER (WHERE list_has_any(p, a)) AS hit, count(*) FILTER (WHERE len(list_filter(p, lambda v: NOT list_contains(a, v))) = 0) AS clean,
 CAST(sum(len(p)) AS BIGINT) AS predicted_labels, CAST(sum(len(list_filter(list_distinct(p), lambda v: NOT list_contains(a, v)))) AS BIGINT) AS wrong_labels FROM x""")
def label_evaluation(spark: SparkSession, d: str) -> DataFrame:
    p = F.split("p_name", " ")
    cases = table(spark, d, "part").select(p.alias("p"), F.array(p[0], F.when(c("p_size") % 3 == 0, p[1]).otherwise("none")).alias("a"))
    return health.evaluate_labels(cases, "p", "a")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS unique_slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", text.slugify(c("p_name")).alias("slug"))
    return history.unique_slugs(rows, "slug", ["p_partkey"]).select("p_partkey", "unique_slug")


@query("""SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size, p_partkey) = 1""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return history.first_wins(rows, F.lower("p_name"), ["p_size", "p_partkey"]).drop("p_size")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), g AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM r GROUP BY ALL), l AS (SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY k) AS locations FROM g GROUP BY 1)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, locations FROM r JOIN l USING (o_custkey) GROUP BY ALL""")
def merge_listings(spark: SparkSession, d: str) -> DataFrame:
    """A row for each requisition group: its first posting, and all its locations in order."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return history.merge_listings(rows, "o_orderkey", "o_custkey", ["o_orderkey"], "o_orderpriority")


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def daily_log_counts(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the streaming log counts."""
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS visible FROM pages""")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.page_text(c("html")).alias("visible"))


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page's links with their best titles (tested against the standard library's HTML parser)."""
    return pages.best_titles(pages.links(table(spark, d, "pages")))


LEXICON = scoring.Lexicon(
    strong={"metal": ["bolt", "steel"], "colour": ["red", "blue"], "make": ["gear", "hammered copper"]},
    weak={"metal": ["copper", "tin"], "colour": ["green"]},
    label_only=["colour"], title_strong=r"(?i)\bbolt", title_weak=r"(?i)\b(?:red|gear)", text_strong=r"(?:steel|copper)", text_weak=r"tin", requirement=r"(?i)polished", negative=r"economy", corporate=r"(?i)\bblue",
)

CATEGORY_SQL = """
WITH t AS (SELECT p_partkey, p_name, lower(p_name) AS t, lower(p_type) AS r FROM part),
w AS (SELECT *, '(^|[^a-z0-9_])(' AS a, ')(s|es)?($|[^a-z0-9_])' AS z FROM t),
s AS (SELECT p_partkey, p_name, t, r,
  CASE WHEN regexp_matches(t, a || 'red|blue' || z) THEN 6 ELSE 0 END + CASE WHEN regexp_matches(t, a || 'green' || z) THEN 3 ELSE 0 END AS ct, CASE WHEN regexp_matches(r, a || 'red' || z) AND regexp_matches(r, a || 'blue' || z) THEN 4 WHEN regexp_matches(r, a || 'red|blue' || z) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(r, a || 'green' || z) THEN 1 ELSE 0 END AS cr,
  CASE WHEN regexp_matches(t, a || 'gear|hammered copper' || z) THEN 6 ELSE 0 END AS gt, CASE WHEN regexp_matches(r, a || 'gear|hammered copper' || z) THEN 3 ELSE 0 END AS gr,
  CASE WHEN regexp_matches(t, a || 'bolt|steel' || z) THEN 6 ELSE 0 END + CASE WHEN regexp_matches(t, a || 'copper|tin' || z) THEN 3 ELSE 0 END AS mt, CASE WHEN regexp_matches(r, a || 'bolt' || z) AND regexp_matches(r, a || 'steel' || z) THEN 4 WHEN regexp_matches(r, a || 'bolt|steel' || z) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(r, a || 'copper' || z) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(r, a || 'tin' || z) THEN 1 ELSE 0 END AS mr FROM w)
SELECT p_partkey, p_name, t, r, list_filter([CASE WHEN ct + cr >= 5 THEN 'colour' END, CASE WHEN gt + gr >= 5 THEN 'make' END, CASE WHEN mt + mr >= 5 THEN 'metal' END], lambda x: x IS NOT NULL) AS categories FROM s"""


@query(f"""WITH c AS ({CATEGORY_SQL}),
x AS (SELECT *, regexp_matches(p_name, '(?i)\\bbolt') AS st, regexp_matches(p_name, '(?i)\\b(red|gear)') AS wk, len(regexp_extract_all(r, 'steel|copper')) AS ds, len(regexp_extract_all(r, 'tin')) AS dw, len(list_filter(categories, lambda v: v <> 'colour')) > 0 AS dom, p_partkey % 3 = 0 AS native FROM c),
y AS (SELECT *, CASE WHEN st THEN 60 WHEN wk THEN 30 ELSE 0 END + CASE WHEN ds >= 3 THEN 35 WHEN ds >= 1 THEN 20 WHEN dw >= 3 THEN 15 ELSE 0 END + CASE WHEN r LIKE '%polished%' THEN 45 ELSE 0 END + CASE WHEN dom AND native THEN 35 WHEN dom THEN 25 ELSE 0 END AS raw FROM x),
z AS (SELECT *, greatest(raw + CASE WHEN native AND raw > 0 THEN 10 ELSE 0 END - CASE WHEN r LIKE '%economy%' OR t LIKE '%economy%' THEN 45 ELSE 0 END - CASE WHEN regexp_matches(p_name, '(?i)\\bblue') AND NOT st THEN 70 ELSE 0 END, 0) AS score FROM y)
SELECT p_partkey, array_to_string(categories, ',') AS categories, score::INTEGER AS relevance_score, score > 0 AND score >= CASE WHEN native THEN 45 ELSE 50 + CASE WHEN NOT st AND NOT wk THEN 15 ELSE 0 END END AS is_audio_related FROM z""")
def categories_and_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Categories and relevance of titles and descriptions under a small lexicon."""
    rows = table(spark, d, "part").select("p_partkey", c("p_name").alias("title"), c("p_type").alias("description"), c("p_type").alias("role_text"), F.when(c("p_partkey") % 3 == 0, "native").otherwise("partial").alias("audio_scope"))
    scored = scoring.with_relevance(scoring.with_categories(rows, LEXICON), LEXICON)
    return scored.select("p_partkey", F.array_join("categories", ",").alias("categories"), "relevance_score", "is_audio_related")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN n_nationkey WHEN 2 THEN n_nationkey WHEN 3 THEN NULL ELSE n_nationkey END AS country FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def country_of_location(spark: SparkSession, d: str) -> DataFrame:
    """Countries of written places; unknown and contradictory ones have none."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    lexicon = nations.select(F.lit("name").alias("kind"), country.fold(c("n_name")).alias("phrase"), c("n_nationkey").alias("country"))
    lexicon = lexicon.union(nations.select(F.lit("city"), F.concat(F.lit("port "), F.lower("n_name"), F.lit(" city")), "n_nationkey"))
    other = nations.select((c("n_nationkey") + 1).alias("before"), c("n_name").alias("other"))
    named = nations.join(other, c("before") == F.when(c("n_nationkey") == 0, 2).otherwise(c("n_nationkey")))
    rows = table(spark, d, "customer").join(named, c("c_nationkey") == c("n_nationkey"))
    place = F.when(c("c_custkey") % 5 == 0, "Remote - anywhere").when(c("c_custkey") % 5 == 1, F.concat(F.lit("Somewhere (hub), "), "n_name")).when(c("c_custkey") % 5 == 2, F.concat(F.lower("n_name"), F.lit(" | office")))
    place = place.when(c("c_custkey") % 5 == 3, F.concat("n_name", F.lit("; "), "other")).otherwise(F.concat(F.lit("Great "), "n_name", F.lit(" area")))
    return country.detect_country(rows.select("c_custkey", place.alias("place")), "place", lexicon).select("c_custkey", "country")


#: names as others write them, by how they are to be found: legal forms, words left out, words in another order, a letter more
_KNOWN = "replace(replace(c_name, '#', ' '), 'Customer', c_mktsegment || ' Audio')"


@query(f"""WITH k AS (SELECT c_custkey, {_KNOWN} AS known, c_mktsegment AS seg, split_part(c_name, '#', 2) AS n FROM customer)
SELECT CASE c_custkey % 4 WHEN 0 THEN upper(known) || ' & Co., Ltd.' WHEN 1 THEN n || ' ' || seg WHEN 2 THEN known || ' Berlin' ELSE 'no ' || reverse(n) || ' such firm x' || c_custkey END AS name, CASE WHEN c_custkey % 4 < 3 THEN known END AS matched FROM k""")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names written otherwise, matched to the known ones: equal but for legal forms, fewer words, more words, unknown."""
    rows = table(spark, d, "customer").withColumn("known", F.replace(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("Customer"), F.concat("c_mktsegment", F.lit(" Audio"))))
    n, k = F.substring_index("c_name", "#", -1), c("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.upper("known"), F.lit(" & Co., Ltd."))).when(k == 1, F.concat_ws(" ", n, "c_mktsegment")).when(k == 2, F.concat("known", F.lit(" Berlin"))).otherwise(F.concat(F.lit("no "), F.reverse(n), F.lit(" such firm x"), "c_custkey"))
    return resolve.match_names(rows.select(name.alias("name")), rows.select(c("known").alias("name")))


@query("""WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS INTEGER) % 90 AS score, 'u' || event_id AS url FROM events), g AS (SELECT user_id, min(event_id) FILTER (WHERE score >= 70) AS stop FROM s GROUP BY 1),
t AS (SELECT s.* FROM s JOIN g USING (user_id) WHERE stop IS NULL OR event_id <= stop)
SELECT user_id, count(*) OVER (PARTITION BY user_id) AS tried, score, url FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", (F.floor("value").cast("int") % 90).alias("score"), F.concat(F.lit("u"), c("event_id")).alias("url"))
    return resolve.best_candidates(rows, "user_id", "event_id", "score", "url")


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """The log read as a stream to its end, counted by day in a table that each batch replaces."""
    source = table(spark, d, "events").schema
    out = work_dir(spark, "stream-counts")
    stream = spark.readStream.schema(source).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = log.daily_counts(stream)
    write = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    write.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/counts")).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts")
