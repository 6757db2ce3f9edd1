"""Queries of the fetch cycle, seeds and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url
from ..operators import cycle, health, moderation, normalize, reports, resolve, scoring, seed
from ..sources.tables import dealt, table
from ..streaming import log
from .fixtures import COMPANIES_SQL, JOBS_SQL, companies, jobs
from .listings import WITH
from .queries import AS_OF, LEXICON, query

c = F.col


# ---- the cycle ----

PERSIST = """
x AS (SELECT o_custkey AS company_id, concat('ext:', CAST(o_orderkey AS VARCHAR(20))) AS identity, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('old ', CAST(o_orderkey AS VARCHAR(20))) END AS description, o_totalprice AS price, o_orderstatus <> 'F' AS is_active, CASE WHEN o_orderkey % 13 = 0 THEN true END AS is_active_override FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT o_custkey AS company_id, concat('ext:', CAST(o_orderkey AS VARCHAR(20))) AS identity, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'new' END AS description, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 5 <> 0),
r AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'success' END AS status, c_custkey % 9 = 0 AS trust_empty, c_custkey % 6 <> 0 AS allow_deactivation FROM customer WHERE c_custkey % 7 <> 0)"""


def _persisted(spark: SparkSession, d: str):
    orders = table(spark, d, "orders")
    stored = orders.where("o_orderkey % 3 <> 0").selectExpr("o_custkey AS company_id", "concat('ext:', o_orderkey) AS identity", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('old ', o_orderkey) END AS description", "o_totalprice AS price", "o_orderstatus <> 'F' AS is_active", "CASE WHEN o_orderkey % 13 = 0 THEN true END AS is_active_override")
    fetched = orders.where("o_orderkey % 5 <> 0").selectExpr("o_custkey AS company_id", "concat('ext:', o_orderkey) AS identity", "CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'new' END AS description", "o_totalprice + 1 AS price")
    outcomes = table(spark, d, "customer").where("c_custkey % 7 <> 0").selectExpr("c_custkey AS company_id", "CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'success' END AS status", "c_custkey % 9 = 0 AS trust_empty", "c_custkey % 6 <> 0 AS allow_deactivation")
    return cycle.persist(stored, fetched, outcomes, companies(spark, d), ["description", "price"], AS_OF)


PERSIST_SQL = f"""WITH {PERSIST}, g AS (SELECT * FROM r WHERE status = 'success'),
h AS (SELECT f.* FROM f JOIN g USING (company_id)), n AS (SELECT company_id, count(*) AS n FROM h GROUP BY 1),
m AS (SELECT coalesce(x.company_id, h.company_id) AS company_id, coalesce(x.identity, h.identity) AS identity, x.identity IS NOT NULL AS stored, h.identity IS NOT NULL AS seen, x.description AS d0, coalesce(nullif(trim(h.description), ''), x.description) AS d1, x.price AS p0, h.price AS p1, coalesce(is_active, false) AS was, is_active_override AS ov FROM x FULL JOIN h ON x.company_id = h.company_id AND x.identity = h.identity),
s AS (SELECT m.*, allow_deactivation AND (trust_empty OR coalesce(n, 0) > 0) AS can FROM m LEFT JOIN g USING (company_id) LEFT JOIN n USING (company_id))
SELECT company_id, identity, CASE WHEN seen THEN d1 ELSE d0 END AS description, CASE WHEN seen THEN p1 ELSE p0 END AS price,
 CASE WHEN seen AND NOT stored THEN 'insert' WHEN seen AND NOT was AND coalesce(ov, true) THEN 'reactivate' WHEN seen THEN 'update' WHEN was AND coalesce(can, false) AND NOT coalesce(ov, false) THEN 'deactivate' ELSE 'keep' END AS action, NOT seen AND was AND NOT coalesce(can, true) AS skipped FROM s"""


@query(PERSIST_SQL)
def persisted_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored postings after a cycle; blank descriptions are filled from the stored ones, failed sources keep their rows."""
    return _persisted(spark, d)[0].select("company_id", "identity", "description", "price", "action", "skipped")


@query(f"WITH k AS ({COMPANIES_SQL}), {PERSIST} SELECT k.id, CASE status WHEN 'success' THEN 0 WHEN 'failed' THEN consecutive_failures + 1 ELSE consecutive_failures END AS failures FROM k LEFT JOIN r ON company_id = k.id")
def persisted_failures(spark: SparkSession, d: str) -> DataFrame:
    return _persisted(spark, d)[1].select("id", c("consecutive_failures").alias("failures"))


@query(f"WITH {PERSIST}, n AS (SELECT company_id, count(*) AS n FROM f GROUP BY 1) SELECT company_id, status, CASE WHEN status = 'success' THEN coalesce(n, 0) ELSE 0 END AS jobs_found FROM r LEFT JOIN n USING (company_id)")
def persisted_log(spark: SparkSession, d: str) -> DataFrame:
    return _persisted(spark, d)[2].select("company_id", "status", "jobs_found")


@query(f"""WITH m AS ({PERSIST_SQL}), o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 30 END AS jobs_found FROM customer WHERE c_custkey % 7 <> 0)
SELECT (SELECT count(*) FROM o) AS companies, (SELECT count(*) FROM o WHERE status = 'success') AS succeeded, (SELECT count(*) FROM o WHERE status <> 'success') AS failed, (SELECT CAST(sum(jobs_found) AS BIGINT) FROM o) AS jobs_found,
count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'reactivate') AS reactivated, count(*) FILTER (WHERE action = 'deactivate') AS deactivated, count(*) FILTER (WHERE action = 'keep') AS kept, count(*) FILTER (WHERE skipped) AS skipped FROM m""")
def cycle_totals(spark: SparkSession, d: str) -> DataFrame:
    return cycle.cycle_totals(_outcomes(spark, d), _persisted(spark, d)[0])[0]


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 7 <> 0").selectExpr("c_custkey AS company_id", "CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'success' END AS status", "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 30 END AS jobs_found", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http' ELSE 'lever' END AS method")


@query("SELECT coalesce(CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http' ELSE 'lever' END, 'none') AS method, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def cycle_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = _outcomes(spark, d)
    return cycle.cycle_totals(rows, rows.selectExpr("'keep' AS action", "false AS skipped"))[1]


@query("""WITH a AS (SELECT c_custkey, 'unverified' AS why FROM customer WHERE c_custkey % 4 = 0), b AS (SELECT c_custkey, 'failing' AS why FROM customer WHERE c_custkey % 6 = 0)
SELECT c_custkey, min(why) AS why FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def discovery_population(spark: SparkSession, d: str) -> DataFrame:
    """Unverified and failing companies, each once."""
    rows = table(spark, d, "customer").select("c_custkey")
    return cycle.discovery_population(rows.where("c_custkey % 4 = 0").withColumn("why", F.lit("unverified")), rows.where("c_custkey % 6 = 0").withColumn("why", F.lit("failing")), "c_custkey")


URLS_SQL = "SELECT o_custkey AS company, o_orderkey % 3 AS url_no, o_totalprice AS price, o_orderkey % 7 AS identity, CASE o_orderkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'lever' ELSE 'http' END AS method, o_orderkey FROM orders"


@query(f"WITH u AS ({URLS_SQL}) SELECT company, identity, price FROM u QUALIFY row_number() OVER (PARTITION BY company, identity ORDER BY url_no, o_orderkey) = 1")
def merged_url_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of a posting found at several URLs of a company, the row of the first URL."""
    rows = spark.sql(URLS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")).withColumn("at", F.struct("url_no", "o_orderkey"))
    return cycle.merged_urls(rows, "company", "at", "identity", "method")[0].select("company", "identity", "price")


@query(f"WITH u AS ({URLS_SQL}), g AS (SELECT company, method, min(url_no * 1000000000 + o_orderkey) AS pos FROM u GROUP BY ALL) SELECT company, string_agg(method, '+' ORDER BY pos) AS methods FROM g GROUP BY 1")
def merged_url_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(URLS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")).withColumn("at", F.struct("url_no", "o_orderkey"))
    return cycle.merged_urls(rows, "company", "at", "identity", "method")[1]


@query(f"""WITH k AS ({COMPANIES_SQL}) SELECT id, name FROM k WHERE EXISTS (SELECT 1 FROM k o WHERE o.ats_type = k.ats_type AND o.ats_slug = k.ats_slug AND o.id <> k.id)""")
def claimed_boards_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    return cycle.claimed_elsewhere(companies(spark, d).where("ats_type is not null and ats_slug is not null"), ["ats_type", "ats_slug"], "id").select("id", "name")


@query("""WITH RECURSIVE o AS (SELECT s_suppkey, 'u' || s_nationkey AS u, CASE WHEN s_acctbal > 0 THEN 'b' || s_suppkey % 17 END AS b, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS us, []::VARCHAR[] AS bs, NULL::BIGINT AS s_suppkey, false AS claimed
UNION ALL SELECT o.n, CASE WHEN free THEN list_append(us, u) ELSE us END, CASE WHEN free AND b IS NOT NULL THEN list_append(bs, b) ELSE bs END, o.s_suppkey, free FROM (SELECT o.*, r.us, r.bs, NOT list_contains(us, u) AND (b IS NULL OR NOT list_contains(bs, b)) AS free FROM r JOIN o ON o.n = r.n + 1) o)
SELECT s_suppkey, claimed FROM r WHERE n > 0""")
def greedy_claims(spark: SparkSession, d: str) -> DataFrame:
    """Who keeps a shared URL or board, going through all suppliers in order: their nations are the URLs, a part of them has boards."""
    board = F.when(c("s_acctbal") > 0, F.concat(F.lit("b"), c("s_suppkey") % 17))
    return resolve.claim_boards(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("U"), "s_nationkey").alias("u"), board.alias("b")), "s_suppkey", "u", "b")


@query("""WITH RECURSIVE h AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS place, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS place, []::DOUBLE[] AS recent, false AS admitted FROM (SELECT DISTINCT key FROM h)
UNION ALL SELECT key, n, place, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM (SELECT h.*, list_filter(r.recent, lambda x: x > h.t - 3 * 86400) AS live FROM r JOIN h ON h.key = r.key AND h.n = r.n + 1))
SELECT key, place, admitted FROM r WHERE n > 0""")
def rate_limit_log(spark: SparkSession, d: str) -> DataFrame:
    """Hits admitted at three a key in any three days."""
    return log.batch_admitted(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 3 * log.DAY)


# ---- scores ----


@query(f"""{WITH} SELECT j.id, CASE WHEN coalesce(job_type, '') = 'full-time' AND j.id % 2 = 0 OR title LIKE 'Junior%' AND j.id % 5 = 0 THEN 'internship' ELSE seniority END AS seniority,
CASE WHEN job_type = 'full-time' AND j.id % 2 = 0 THEN NULL ELSE job_type END AS job_type, CASE WHEN title LIKE 'Junior%' AND j.id % 5 = 0 THEN 'title' WHEN job_type = 'full-time' AND j.id % 2 = 0 THEN 'type_only' END AS reason FROM j""")
def internship_levels(spark: SparkSession, d: str) -> DataFrame:
    """Internships as a level: rows whose title says so, and rows that only have the type."""
    rows = jobs(spark, d).withColumn("title", F.when(c("title").startswith("Junior") & (c("id") % 5 == 0), "Trainee engineer").otherwise(c("title"))).withColumn("job_type", F.when((c("job_type") == "full-time") & (c("id") % 2 == 0), "internship").otherwise(c("job_type")))
    return normalize.relabel_internships(rows).select("id", "seniority", "job_type", "reason")


DOMINANT = scoring.Lexicon(strong={"metal": ["bolt"], "colour": ["red"], "make": ["gear"]}, weak={"metal": ["widget"]}, dominance={"metal": ["colour", "make"]})


@query("""WITH t AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'red gear red' WHEN 1 THEN 'red bolt' ELSE 'gear' END AS r FROM part),
s AS (SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 6 ELSE 0 END AS ct, CASE WHEN r LIKE '%red%' THEN 3 ELSE 0 END AS cr, CASE WHEN p_name LIKE '%gear%' THEN 6 ELSE 0 END AS gt, CASE WHEN r LIKE '%gear%' THEN 3 ELSE 0 END AS gr,
 CASE WHEN p_name LIKE '%bolt%' THEN 6 ELSE 0 END + CASE WHEN p_name LIKE '%widget%' THEN 3 ELSE 0 END AS mt, CASE WHEN r LIKE '%bolt%' THEN 3 ELSE 0 END AS mr FROM t),
d AS (SELECT *, mt > 0 AND mt + mr >= 5 AS rules FROM s)
SELECT p_partkey, concat_ws(',', CASE WHEN ct + cr >= 5 AND NOT (rules AND ct = 0) THEN 'colour' END, CASE WHEN gt + gr >= 5 AND NOT (rules AND gt = 0) THEN 'make' END, CASE WHEN mt + mr >= 5 THEN 'metal' END) AS categories FROM d""")
def dominant_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories where one that the title names outweighs those below it."""
    role = F.expr("CASE p_size % 3 WHEN 0 THEN 'red gear red' WHEN 1 THEN 'red bolt' ELSE 'gear' END")
    rows = table(spark, d, "part").select("p_partkey", c("p_name").alias("title"), role.alias("role_text"))
    return scoring.with_categories(rows, DOMINANT).select("p_partkey", F.array_join("categories", ",").alias("categories"))


@query(f"""{WITH} SELECT count(*) AS total, count(*) FILTER (WHERE id % 4 = 0) AS relevance_score_changed, count(*) FILTER (WHERE id % 6 = 0 AND seniority IS NOT NULL) AS seniority_changed FROM j""")
def rescoring_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a rescoring changes."""
    before = jobs(spark, d)
    after = before.withColumns({"relevance_score": c("relevance_score") + F.when(c("id") % 4 == 0, 1).otherwise(0), "seniority": F.when(c("id") % 6 == 0, None).otherwise(c("seniority"))})
    return cycle.recomputed(before, after, "id", ["relevance_score", "seniority"])


@query()
def normalized_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Raw postings through the whole row pipeline (tested against literal rows)."""
    raw = jobs(spark, d).select(
        "id", c("title"), "url", "description", "location", c("job_type"), "posted_date", F.lit(False).alias("remote_hint"), F.when(c("id") % 2 == 0, "native").otherwise("partial").alias("audio_scope"), F.lit("Tools").alias("company_category"), F.lit(None).cast("string").alias("company_name")
    )
    return normalize.normalize(raw, LEXICON, ["colour", "make", "metal"], domains={"Tools": "metal"}).withColumn("job_categories", F.array_join("job_categories", ","))


# ---- seeds ----

ENTRIES_SQL = """SELECT c_custkey AS place, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN concat(c_name, ' New') ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('https://s', CAST(c_custkey AS VARCHAR(20)), '.example.org') END AS careers_url, CASE WHEN c_custkey % 4 <> 3 THEN 1 ELSE 0 END AS has_url FROM customer WHERE c_custkey < 120"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(ENTRIES_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))
    return rows.select("place", "name", "careers_url", F.when(c("has_url") == 1, F.array(F.lit("name"), F.lit("careers_url"))).otherwise(F.array(F.lit("name"))).alias("present"))


@query(f"""WITH k AS ({COMPANIES_SQL}), e AS ({ENTRIES_SQL}), m AS (SELECT e.*, k.id FROM e LEFT JOIN k ON lower(trim(k.name)) = lower(trim(e.name)))
SELECT k.id, k.name, CASE WHEN m.id IS NOT NULL AND source <> 'manual' AND has_url = 1 THEN m.careers_url ELSE k.careers_url END AS careers_url, CASE WHEN m.id IS NULL THEN 'keep' WHEN source = 'manual' THEN 'protected' ELSE 'update' END AS action FROM k LEFT JOIN m ON m.id = k.id
UNION ALL SELECT NULL, name, careers_url, 'insert' FROM m WHERE id IS NULL""")
def seed_load(spark: SparkSession, d: str) -> DataFrame:
    """Companies after a seed: absent keys leave a column alone, manual rows are protected, new names are inserted."""
    return seed.load(_entries(spark, d), companies(spark, d), ["careers_url"]).select("id", "name", "careers_url", "action")


CHANGES_SQL = "SELECT s_suppkey AS place, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat(s_name, ' II') END AS name, CASE WHEN s_suppkey % 2 = 1 THEN upper(s_name) END AS was, s_acctbal AS value FROM supplier WHERE s_suppkey % 3 <> 0"


@query(f"""WITH e AS (SELECT s_name AS name, 0.5::DOUBLE AS value FROM supplier), h AS ({CHANGES_SQL})
SELECT name, value FROM e WHERE lower(name) NOT IN (SELECT lower(name) FROM h) AND lower(name) NOT IN (SELECT lower(was) FROM h WHERE was IS NOT NULL) UNION ALL SELECT name, value FROM h""")
def seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Seed entries after changes, some of which rename."""
    entries = table(spark, d, "supplier").select(c("s_name").alias("name"), F.lit(0.5).alias("value"))
    changes = spark.sql(CHANGES_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    return seed.upsert(entries, changes)


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0")
def seed_removal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(c("s_name").alias("name"), "s_suppkey")
    return seed.remove(rows, rows.where("s_suppkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("name"), F.lit(" ")).alias("name"))).select("name")


@query("""WITH e AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 10 = 3 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'odd' ELSE 'native' END AS scope, p_partkey % 11 = 0 AS extra FROM part),
l AS (SELECT place, lower(trim(name)) AS low FROM e)
SELECT place, 'error' AS level, 'missing name' AS message FROM e WHERE name = '' UNION ALL SELECT place, 'error', 'unexpected colour' FROM e WHERE extra UNION ALL SELECT place, 'error', 'unknown scope odd' FROM e WHERE scope = 'odd'
UNION ALL SELECT place, 'error', 'duplicate ' || low FROM l WHERE place <> (SELECT min(place) FROM l x WHERE x.low = l.low)
UNION ALL SELECT l.place, 'warning', 'out of order ' || l.low FROM l JOIN l b ON b.place + 1 = l.place WHERE l.low < b.low""")
def seed_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each entry of a seed."""
    rows = table(spark, d, "part").selectExpr("p_partkey AS place", "CASE WHEN p_partkey % 10 = 3 THEN '' ELSE p_name END AS name", "CASE WHEN p_partkey % 7 = 0 THEN 'odd' ELSE 'native' END AS scope", "CASE WHEN p_partkey % 11 = 0 THEN array('name', 'scope', 'colour') ELSE array('name', 'scope') END AS keys")
    return seed.validate(rows, ["name"], ["name", "scope"], {"scope": ["native", "partial", "all"]})


@query("""SELECT c_custkey, '{"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"slug":"s"' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ',"verified":true' ELSE '' END || '}' AS entry FROM customer""")
def seed_entry_json(spark: SparkSession, d: str) -> DataFrame:
    """Sparse objects of the rows: what is null, false or empty is left out."""
    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE '' END AS slug", "c_custkey % 2 = 0 AS verified", "CAST(NULL AS STRING) AS note")
    return rows.select("c_custkey", seed.entry_json(["name", "slug", "verified", "note"]).alias("entry"))


@query("SELECT c_mktsegment AS category, count(*) AS total, count(*) FILTER (WHERE c_custkey % 3 = 0) AS verified, round(100 * count(*) FILTER (WHERE c_custkey % 3 = 0) / count(*), 1) AS percent FROM customer GROUP BY 1")
def verified_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(c("c_mktsegment").alias("category"), F.when(c("c_custkey") % 3 == 0, True).alias("ok"))
    return seed.verified_share(rows, "category", "ok")


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'follow' WHEN c_custkey % 2 = 0 THEN 'crawl' ELSE c_mktsegment END AS url, CAST(CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS origin FROM customer""")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Verified data under crawled and followed results, the last layer with a value first."""
    base = table(spark, d, "customer").select(c("c_name").alias("name"), c("c_mktsegment").alias("url"), "c_custkey")
    crawl = base.where("c_custkey % 2 = 0").select("name", F.lit("crawl").alias("url"))
    follow = base.where("c_custkey % 5 = 0").select("name", F.lit("follow").alias("url")).union(base.where("c_custkey % 5 = 1").select("name", F.lit(None).cast("string")))
    return seed.merge_results(base, crawl, follow).drop("c_custkey")


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Pro (EU)' ELSE p_name || ' Studio Inc' END AS name, p_size FROM part), r AS (SELECT *, name LIKE '%(%' AS b FROM n)
SELECT p_size, split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) AS root, min(struct_pack(b := b, n := length(name) - CASE WHEN b THEN 2 WHEN name LIKE '% Inc' THEN 4 ELSE 0 END, l := length(name), name := name)).name AS name FROM r GROUP BY ALL""")
def brand_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Of the names of one brand at one URL, the one without brackets, then the shortest."""
    rows = table(spark, d, "part").selectExpr("p_size", "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' Pro (EU)') ELSE concat(p_name, ' Studio Inc') END AS name")
    found = resolve.brand_representatives(rows, "p_size", seed.brand_root(c("name")), "name")
    return found.select("p_size", seed.brand_root(c("name")).alias("root"), "name")


@query("""WITH n AS (SELECT DISTINCT p_size, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS name FROM part) SELECT p_size, name, name LIKE '% %' AND EXISTS (SELECT 1 FROM n o WHERE o.p_size = n.p_size AND o.name = split_part(n.name, ' ', 1)) AS has_parent FROM n""")
def names_with_parent(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with another name at their URL."""
    rows = table(spark, d, "part").select("p_size", F.when(c("p_partkey") % 2 == 0, c("p_name")).otherwise(F.substring_index("p_name", " ", 1)).alias("name")).distinct()
    return seed.has_parent(rows, "p_size", "name")


# ---- reports ----


@query("""WITH r AS (SELECT event_id AS place, CASE WHEN user_id % 5 = 0 THEN '' ELSE CASE WHEN event_id % 3 = 0 THEN 'ACME ' ELSE 'Acme ' END || user_id || ' GmbH' END AS company_name, event_type AS search_term, props AS title, CASE WHEN event_id % 4 = 0 THEN 'u' || event_id END AS company_url FROM events), k AS (SELECT *, 'acme ' || split_part(company_name, ' ', 2) AS key FROM r WHERE company_name <> ''),
s AS (SELECT key, company_name, count(*) AS n, min(place) AS pos FROM k GROUP BY ALL), t AS (SELECT key, title, min(place) AS pos FROM k GROUP BY ALL)
SELECT key AS normalized_name, count(*) AS hit_count, (SELECT company_name FROM s WHERE s.key = k.key ORDER BY n DESC, pos LIMIT 1) AS name, array_to_string(list_sort(list(DISTINCT search_term)), ',') AS search_terms, min_by(company_url, place) FILTER (WHERE company_url IS NOT NULL) AS company_url,
(SELECT string_agg(title, ';' ORDER BY pos) FROM (SELECT title, pos FROM t WHERE t.key = k.key ORDER BY pos LIMIT 3)) AS titles FROM k GROUP BY key""")
def company_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Companies that found postings name: commonest spelling, terms, first titles and URL."""
    rows = table(spark, d, "events").selectExpr("event_id AS place", "CASE WHEN user_id % 5 = 0 THEN '' ELSE concat(CASE WHEN event_id % 3 = 0 THEN 'ACME ' ELSE 'Acme ' END, user_id, ' GmbH') END AS company_name", "event_type AS search_term", "props AS title", "CASE WHEN event_id % 4 = 0 THEN concat('u', event_id) END AS company_url")
    found = reports.candidates(rows, "place", sets=("search_term",), samples={"title": 3})
    return found.select("normalized_name", "hit_count", "name", F.array_join("search_terms", ",").alias("search_terms"), "company_url", F.array_join("titles", ";").alias("titles"))


@query("SELECT n_name AS name, CAST(n_nationkey % 7 AS BIGINT) AS hit_count FROM nation WHERE n_nationkey % 7 >= 2 ORDER BY hit_count DESC, n_nationkey % 3 DESC, lower(n_name) LIMIT 10")
def ranked_proposals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(c("n_name").alias("name"), (c("n_nationkey") % 7).cast("long").alias("hit_count"), F.array_repeat(F.lit("t"), (c("n_nationkey") % 3)).alias("search_terms"))
    return reports.rank_candidates(rows, 2, 10).select("name", "hit_count")


@query(f"""WITH k AS ({COMPANIES_SQL}), b AS (SELECT * FROM k WHERE ats_type IS NOT NULL), n AS (SELECT ats_type, ats_slug, count(*) AS n FROM b WHERE ats_slug <> '' GROUP BY ALL)
SELECT id, name, concat_ws(',', CASE WHEN b.ats_slug = '' THEN 'empty_slug' END, CASE WHEN b.ats_type <> 'lever' THEN 'unknown_ats' END, CASE WHEN n > 1 THEN 'duplicate_binding' END, CASE WHEN b.ats_slug <> '' THEN 'slug_unrelated' END) AS problems, coalesce(n, 1) - 1 AS shared_with FROM b LEFT JOIN n USING (ats_type, ats_slug)""")
def binding_audit(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the companies' bindings to boards; the slugs here are related to no name."""
    return reports.binding_audit(companies(spark, d), ["lever"]).select("id", "name", F.array_join("problems", ",").alias("problems"), "shared_with")


@query(f"""{WITH}, m AS (SELECT id AS company_id, CASE WHEN id % 2 = 0 THEN 'lever' ELSE 'other' END AS scrape_method, id % 9 AS jobs_found, id % 3 AS careers_url_count FROM k), n AS (SELECT company_id, count(*) FILTER (WHERE is_active) AS a, count(*) FILTER (WHERE is_active AND is_audio_related) AS b FROM j GROUP BY 1)
SELECT company_id, jobs_found, CAST(4 * greatest(1, careers_url_count) AS BIGINT) AS cap, coalesce(a, 0) AS active_jobs, coalesce(b, 0) AS board_jobs FROM m LEFT JOIN n USING (company_id) WHERE scrape_method = 'lever' AND jobs_found >= 4 * greatest(1, careers_url_count)""")
def truncation_report(spark: SparkSession, d: str) -> DataFrame:
    """Sources that returned as much as their method can."""
    metrics = companies(spark, d).selectExpr("id AS company_id", "CASE WHEN id % 2 = 0 THEN 'lever' ELSE 'other' END AS scrape_method", "id % 9 AS jobs_found", "id % 3 AS careers_url_count")
    return reports.truncation(metrics, jobs(spark, d), {"lever": 4}).select("company_id", "jobs_found", c("cap").cast("long").alias("cap"), "active_jobs", "board_jobs")


@query("""WITH u AS (SELECT event_id, 'u' || user_id % 40 AS url FROM events), f AS (SELECT url, event_id, row_number() OVER (PARTITION BY url ORDER BY event_id) AS r FROM u)
SELECT url, count(*) AS n, min(event_id) AS place, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE r <= 20) AS ids FROM f GROUP BY 1""")
def links_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Each URL once, by first appearance, with the first rows that have it."""
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), c("user_id") % 40).alias("url"))
    return reports.by_url(rows, "url", "event_id", "event_id").select("url", "n", "place", F.array_join("ids", ",").alias("ids"))


@query(f"""{WITH} SELECT id, relevance_score FROM j ORDER BY is_audio_related DESC, relevance_score DESC, id LIMIT 30""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).orderBy(*reports.sample_order(c("is_audio_related"), c("relevance_score"), c("id"))).limit(30).select("id", "relevance_score")


@query("""SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation""")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.as_markdown(table(spark, d, "nation"), ["n_nationkey", "n_name"])


@query("""WITH k AS (SELECT c_custkey AS id, lower(c_mktsegment) AS seg, lower(regexp_replace(n_name, '[^A-Z]', '', 'g')) AS land, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT id, seg, land, CASE WHEN c_acctbal < 0 THEN 'https://' || land || '.example.com/404' WHEN c_acctbal < 2500 THEN 'https://' || land || '.example.com/about' WHEN c_acctbal < 5000 THEN 'https://' || land || '.example.com/careers' WHEN c_acctbal < 7000 THEN 'https://' || seg || '.example.com/about' WHEN c_acctbal < 9000 THEN 'https://' || seg || '.example.com/jobs' ELSE 'https://jobs.lever.co/' || land END AS u FROM k)
SELECT id, CASE WHEN contains(u, '/404') THEN 'bad_page' WHEN contains(u, 'lever.co') THEN NULL WHEN NOT contains(regexp_extract(u, '://([^/]*)', 1), seg) AND NOT regexp_matches(u, 'careers|jobs') THEN 'wrong_host_no_vocab' WHEN NOT contains(regexp_extract(u, '://([^/]*)', 1), seg) THEN 'wrong_host_careers_shaped' WHEN NOT regexp_matches(u, 'careers|jobs') THEN 'right_host_no_vocab' END AS problem FROM s""")
def url_audit(spark: SparkSession, d: str) -> DataFrame:
    """Seed URLs that are bad pages, or on another's host, or no careers pages."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"))
    seg, land, b = F.lower("c_mktsegment"), F.lower(F.regexp_replace("n_name", "[^A-Z]", "")), c("c_acctbal")
    at = lambda host, path: F.concat(F.lit("https://"), host, F.lit(f".example.com/{path}"))
    u = F.when(b < 0, at(land, "404")).when(b < 2500, at(land, "about")).when(b < 5000, at(land, "careers")).when(b < 7000, at(seg, "about")).when(b < 9000, at(seg, "jobs")).otherwise(F.concat(F.lit("https://jobs.lever.co/"), land))
    seeds = dealt(rows.select(c("c_custkey").alias("id"), u.alias("url"), F.concat("c_mktsegment", F.lit(" Ltd")).alias("name")), "id")
    return seeds.select("id", url.audit_url(c("url"), c("name")).alias("problem"))


@query("""SELECT CASE WHEN c_custkey % 8 = 0 THEN 'failing' WHEN c_custkey % 3 = 0 THEN 'idle' ELSE 'healthy' END AS grade, c_custkey, c_name FROM customer ORDER BY CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 4 ELSE 5 END DESC, lower(c_name) LIMIT 20""")
def health_order(spark: SparkSession, d: str) -> DataFrame:
    """Companies by grade from the best, names ascending within a grade."""
    grade = F.when(c("c_custkey") % 8 == 0, "failing").when(c("c_custkey") % 3 == 0, "idle").otherwise("healthy")
    rows = table(spark, d, "customer").select(grade.alias("grade"), "c_custkey", "c_name")
    return rows.orderBy(health.grade_rank(c("grade")).desc(), F.lower("c_name").asc()).limit(20)


@query(f"WITH j AS ({JOBS_SQL}) SELECT count(*) AS n FROM j WHERE is_active_override = false")
def hidden_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).withColumns({"company_name": F.lit(""), "company_failures": F.lit(0)})
    return moderation.admin_jobs(rows, "hidden").agg(F.count("*").alias("n"))
