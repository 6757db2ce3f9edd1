"""Queries of the board, the directory and moderation, through the library's operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import board, cycle, history, lifecycle, moderation
from ..sources.tables import table
from .fixtures import COMPANIES_SQL, JOBS_SQL, companies, jobs
from .queries import AS_OF, query

c = F.col
WITH = f"WITH j AS ({JOBS_SQL}), k AS ({COMPANIES_SQL})"
BOARD_SQL = f"""{WITH}, b AS (SELECT j.*, k.name AS company_name, k.consecutive_failures AS company_failures FROM j LEFT JOIN k ON j.company_id = k.id),
l AS (SELECT *, source = 'community' OR coalesce(is_active_override, false) OR company_id IS NULL OR coalesce(company_failures < 3, false) AS listable FROM b)"""


def dated(sql: str, *columns: str) -> str:
    """The SQL with dates as text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({x} AS VARCHAR) AS {x}' for x in columns)}) FROM ({sql})"


def as_text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({x: c(x).cast("string") for x in columns})


SHOWN = ("id", "title", "company_name", "country", "salary_min", "salary_max")


def _board(spark: SparkSession, d: str) -> DataFrame:
    return board.with_company(jobs(spark, d), companies(spark, d))


def _page_sql(where: str, order: str, size: int, number: int, tail: str = "false") -> str:
    return f"""{BOARD_SQL}, f AS (SELECT * FROM l WHERE is_active AND listable AND {where}),
t AS (SELECT count(*) FILTER (WHERE NOT ({tail})) AS total, CAST(ceil(count(*) / {size}.0) AS BIGINT) AS pages FROM f)
SELECT {', '.join(SHOWN)}, total, pages FROM (SELECT * FROM f ORDER BY {order}, id LIMIT {size} OFFSET {size * (number - 1)}) f, t"""


SEEN = "coalesce(posted_date, CAST(created_at AS DATE))"


@query(_page_sql("is_audio_related AND country = 'DE' IS DISTINCT FROM false AND remote IS NOT DISTINCT FROM false", f"{SEEN} DESC NULLS LAST, created_at DESC NULLS LAST", 20, 2).replace("country = 'DE' IS DISTINCT FROM false", "(country = 'DE' OR country IS NULL)"))
def board_newest(spark: SparkSession, d: str) -> DataFrame:
    """Second page of postings on site in one country or an unknown one, the newest first."""
    f = board.JobFilter(country="de", remote=False)
    return board.page(board.filter_jobs(_board(spark, d), f), board.job_order("newest"), 2, 20).select(*SHOWN, "total", "pages")


@query(_page_sql("(salary_max IS NULL OR salary_max >= 30000) AND (salary_min IS NULL OR salary_min <= 60000) AND seniority IN ('senior', 'mid') AND location ILIKE '%City 1%'", f"coalesce(salary_max, salary_min, 0) DESC, {SEEN} DESC NULLS LAST", 15, 1))
def board_by_salary(spark: SparkSession, d: str) -> DataFrame:
    f = board.JobFilter(seniority=["Senior", " mid ", ""], salary_min=30_000, salary_max=60_000, location="City 1", include_unrelated=True)
    return board.page(board.filter_jobs(_board(spark, d), f), board.job_order("salary_desc"), 1, 15).select(*SHOWN, "total", "pages")


@query(_page_sql("is_audio_related AND company_name ILIKE '%0001%' AND (job_type IN ('full-time', 'contract') OR job_type IS NULL)", f"job_type IS NULL, CASE WHEN country = 'US' THEN 0 ELSE 1 END, {SEEN} ASC NULLS LAST, created_at ASC NULLS LAST", 10, 1, "job_type IS NULL"))
def board_untyped_last(spark: SparkSession, d: str) -> DataFrame:
    """Unknown types come last and do not count in the total, but in the pages."""
    f = board.JobFilter(job_type=["full-time", "contract"], untyped_last=True, company="0001")
    rows = board.filter_jobs(_board(spark, d), f)
    return board.page(rows, board.job_order("oldest", country_first="us", untyped_last=True), 1, 10, c("job_type").isNull()).select(*SHOWN, "total", "pages")


@query(_page_sql("(regexp_matches(title, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') OR regexp_matches(description, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])')) AND (regexp_matches(title, '(?i)(^|[^a-z0-9])promo') OR regexp_matches(description, '(?i)(^|[^a-z0-9])promo')) AND list_has_any(job_categories, ['bolt', 'large'])", f"CASE WHEN regexp_matches(title, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') AND regexp_matches(title, '(?i)(^|[^a-z0-9])promo') THEN 0 ELSE 1 END, {SEEN} DESC NULLS LAST, created_at DESC NULLS LAST", 12, 1))
def board_search(spark: SparkSession, d: str) -> DataFrame:
    """Postings that have both words somewhere, in wanted categories; those with both in the headline first."""
    f = board.JobFilter(search="Bolt, promo", category=["bolt", "large"], include_unrelated=True)
    return board.page(board.filter_jobs(_board(spark, d), f), board.job_order(search="Bolt, promo"), 1, 12).select(*SHOWN, "total", "pages")


@query(_page_sql("id IN (4, 8, 13, 22, 44, 91) AND company_id = company_id", f"coalesce(salary_max, salary_min, 1000000000), {SEEN} DESC NULLS LAST", 10, 1))
def board_by_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = board.filter_jobs(_board(spark, d), board.JobFilter(ids=(4, 8, 13, 22, 44, 91), include_unrelated=True)).where("company_id is not null")
    return board.page(rows, board.job_order("salary_asc"), 1, 10).select(*SHOWN, "total", "pages")


@query(f"{BOARD_SQL} SELECT id, title FROM l WHERE false")
def board_no_ids(spark: SparkSession, d: str) -> DataFrame:
    """An empty list of ids asks for no row."""
    return board.filter_jobs(_board(spark, d), board.JobFilter(ids=())).select("id", "title")


@query(dated(f"{BOARD_SQL} SELECT id, title, company_name, featured_at FROM l WHERE is_active AND listable AND is_audio_related AND featured_at IS NOT NULL AND (featured_until IS NULL OR featured_until >= DATE '1998-01-01') ORDER BY featured_at DESC, id DESC LIMIT 12", "featured_at"))
def featured_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = board.filter_jobs(_board(spark, d), board.JobFilter()).where(board.featured(c("featured_at"), c("featured_until"), AS_OF))
    return as_text(board.first_by(rows, [c("featured_at").desc(), c("id").desc()], 12).select("id", "title", "company_name", "featured_at"), "featured_at")


@query(f"{BOARD_SQL} SELECT id, title, company_name, listable, featured_at IS NOT NULL AND (featured_until IS NULL OR featured_until >= DATE '1998-01-01') AS featured, coalesce(is_audio_related_override, is_audio_related) AS related, array_to_string(coalesce(categories_override, job_categories), ',') AS categories FROM l WHERE id = 62")
def job_detail(spark: SparkSession, d: str) -> DataFrame:
    """One posting with what is computed of it."""
    rows = _board(spark, d).where("id = 62")
    return rows.select(
        "id", "title", "company_name", board.listable(c("source"), c("is_active_override"), c("company_id"), c("company_failures")).alias("listable"), board.featured(c("featured_at"), c("featured_until"), AS_OF).alias("featured"),
        lifecycle.effective(c("is_audio_related_override"), c("is_audio_related")).alias("related"), F.array_join(lifecycle.effective(c("categories_override"), c("job_categories")), ",").alias("categories"),
    )


@query(f"""{WITH}, n AS (SELECT company_id, count(*) AS postings FROM j WHERE is_active AND is_audio_related GROUP BY 1)
SELECT k.id, k.name, coalesce(postings, 0) AS postings FROM k LEFT JOIN n ON company_id = k.id WHERE category = 'MACHINERY' AND verified AND (name ILIKE '%0%' OR slug ILIKE '%zz%') AND postings > 0 ORDER BY postings DESC, k.name LIMIT 50""")
def company_directory(spark: SparkSession, d: str) -> DataFrame:
    """Verified companies of a category that are hiring, the largest first."""
    listed = jobs(spark, d).where("is_active and is_audio_related").withColumnRenamed("id", "job").withColumn("id", c("company_id"))
    rows = companies(spark, d).where((c("category") == "MACHINERY") & c("verified") & (c("name").ilike("%0%") | c("slug").ilike("%zz%")))
    hiring = rows.join(listed.select("id").distinct(), "id", "left_semi")
    counted = board.child_counts(hiring.select("id", "name"), listed, "id", postings=F.lit(True))
    return board.first_by(counted, [c("postings").desc(), c("name").asc()], 50)


@query(dated(f"""{WITH}, f AS (SELECT * FROM j WHERE company_id = 13 AND is_active), t AS (SELECT count(*) AS n FROM f)
SELECT id, title, posted_date, n FROM (SELECT * FROM f ORDER BY posted_date DESC NULLS LAST, created_at DESC, id LIMIT 3) x, t""", "posted_date"))
def company_detail(spark: SparkSession, d: str) -> DataFrame:
    """A company's newest postings, and how many it has in all."""
    rows = jobs(spark, d).where("company_id = 13 and is_active")
    newest = board.first_by(rows, [c("posted_date").desc_nulls_last(), c("created_at").desc(), c("id").asc()], 3)
    return as_text(newest.select("id", "title", "posted_date").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))), "posted_date")


@query(f"{WITH}, n AS (SELECT company_id, count(*) FILTER (WHERE is_active) AS n FROM j GROUP BY 1) SELECT k.id, k.name, coalesce(n, 0) AS open_roles FROM k LEFT JOIN n ON company_id = k.id WHERE open_application")
def open_applications_list(spark: SparkSession, d: str) -> DataFrame:
    """Companies that take open applications, with their open roles."""
    rows = companies(spark, d).where("open_application").select("id", "name")
    return board.child_counts(rows, jobs(spark, d).select(c("company_id").alias("id"), "is_active"), "id", open_roles=c("is_active"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO' AND p_size > 10 ORDER BY p_size, p_name, p_partkey LIMIT 30")
def resources_list(spark: SparkSession, d: str) -> DataFrame:
    """Published resources of a category in their order; parts stand for resources."""
    rows = table(spark, d, "part").where("p_type = 'PROMO' and p_size > 10")
    return board.first_by(rows, [c("p_size").asc(), c("p_name").asc(), c("p_partkey").asc()], 30).select("p_partkey", "p_name", "p_size")


@query("""SELECT event_id, user_id, event_type, last_success FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) e, (SELECT max(ts) AS last_success FROM events WHERE event_type = 'purchase') m""")
def scrape_status(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty rows of the log, and when a fetch last went well."""
    log = table(spark, d, "events")
    last = log.where("event_type = 'purchase'").agg(F.max("ts").alias("last_success"))
    return board.first_by(log, [c("event_id").desc()], 20).select("event_id", "user_id", "event_type").crossJoin(F.broadcast(last))


@query(f"""{BOARD_SQL} SELECT id, title, is_active, relevance_score, coalesce(is_active AND is_audio_related AND listable, false) AS on_board FROM l
WHERE (is_active_override IS NOT NULL OR is_audio_related_override IS NOT NULL OR categories_override IS NOT NULL) AND (regexp_matches(title, '(?i)(^|[^a-z0-9])gear($|[^a-z0-9])') OR regexp_matches(title, '(?i)(^|[^a-z0-9])widget') OR company_name ILIKE '%widget%' OR regexp_matches(company_name, '(?i)(^|[^a-z0-9])gear($|[^a-z0-9])'))
ORDER BY is_active DESC, relevance_score DESC, id DESC LIMIT 40""")
def admin_overridden(spark: SparkSession, d: str) -> DataFrame:
    """Overridden postings that have any of the words, as moderators see them."""
    rows = moderation.admin_jobs(_board(spark, d), "overridden", "gear widget")
    return board.first_by(rows, moderation.admin_order(), 40).select("id", "title", "is_active", "relevance_score", "on_board")


STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'pending' END"
SUBMISSIONS_SQL = f"SELECT o_orderkey AS submission_id, o_custkey AS company_id, {STATE} AS status, o_orderdate AS created_at FROM orders"


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS submission_id", "o_custkey AS company_id", f"{STATE} AS status", "o_orderdate AS created_at")


@query(f"WITH s AS ({SUBMISSIONS_SQL}) SELECT submission_id, company_id, c_name AS company_name FROM s JOIN customer ON c_custkey = company_id WHERE status = 'pending'")
def suggestion_queue(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions that wait, with their company's name."""
    rows = moderation.queue(_submissions(spark, d), "pending")
    named = moderation.with_parent(rows, table(spark, d, "customer").withColumnRenamed("c_name", "name"), "company_id", "c_custkey", ["name"], "company")
    return named.select("submission_id", "company_id", "company_name")


@query(f"""{WITH}, f AS (SELECT event_id AS feedback_id, event_id % 1500 AS job_id, CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM events)
SELECT feedback_id, job_id, title AS job_title, name AS company_name FROM f JOIN j ON j.id = job_id LEFT JOIN k ON k.id = company_id WHERE status = 'rejected'""")
def feedback_queue(spark: SparkSession, d: str) -> DataFrame:
    """Rejected feedback with its posting, and the posting's company if it has one."""
    rows = table(spark, d, "events").selectExpr("event_id AS feedback_id", "event_id % 1500 AS job_id", "CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status")
    named = moderation.with_parent(moderation.queue(rows, "rejected"), jobs(spark, d), "job_id", "id", ["title", "company_id"], "job")
    both = moderation.with_parent(named.withColumnRenamed("job_company_id", "company_id"), companies(spark, d), "company_id", "id", ["name"], "company", "left")
    return both.select("feedback_id", "job_id", "job_title", "company_name")


@query(f"""{WITH}, w AS (SELECT o_orderkey AS request, upper(concat('https://board.example.com/jobs/', CAST(o_orderkey AS VARCHAR(20)))) AS url, CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS company_id FROM orders WHERE o_orderkey % 2 = 0)
SELECT request, min(j.id) AS id FROM w LEFT JOIN j ON lower(j.url) = lower(w.url) AND j.company_id IS NOT DISTINCT FROM w.company_id AND source = 'community' AND is_active GROUP BY 1""")
def live_community_job(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS request", "upper(concat('https://board.example.com/jobs/', CAST(o_orderkey AS STRING))) AS url", "CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS company_id")
    return moderation.live_job(jobs(spark, d), wanted)


@query(dated(f"""WITH s AS ({SUBMISSIONS_SQL}), d AS (SELECT event_id % 1500 AS submission_id, event_type AS reviewer, CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN event_id % 2 = 1 THEN 'spam' END AS reason FROM events),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY reviewer, decision) = 1)
SELECT s.submission_id, CASE WHEN o.submission_id IS NOT NULL AND status = 'pending' THEN decision ELSE status END AS status, CASE WHEN status = 'pending' THEN reviewer END AS reviewed_by, CASE WHEN status = 'pending' AND reviewer IS NOT NULL THEN DATE '1998-01-01' END AS reviewed_at, CASE WHEN status = 'pending' THEN reason END AS reason,
CASE WHEN o.submission_id IS NULL THEN 'kept' WHEN status = 'pending' THEN 'done' ELSE 'conflict' END AS outcome FROM s LEFT JOIN o USING (submission_id)""", "reviewed_at"))
def moderation_transition(spark: SparkSession, d: str) -> DataFrame:
    """Submissions after the reviewers' decisions; those no longer pending are conflicts."""
    decisions = table(spark, d, "events").selectExpr("event_id % 1500 AS submission_id", "event_type AS reviewer", "CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision", "CASE WHEN event_id % 2 = 1 THEN 'spam' END AS reason")
    return as_text(moderation.transition(_submissions(spark, d), decisions, "submission_id", AS_OF).drop("company_id", "created_at"), "reviewed_at")


@query(dated(f"""{WITH}, s AS (SELECT o_orderkey AS submission_id, concat('https://board.example.com/jobs/', CAST(o_orderkey AS VARCHAR(20))) AS url, CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS company_id, 'New title' AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 500 END AS override_days, CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS requested_days, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 14 ELSE 0 END AS INT) AS feature_days FROM orders WHERE o_orderkey % 22 = 0 OR o_orderkey % 50 = 1),
m AS (SELECT s.*, j.id, DATE '1998-01-01' + least(greatest(coalesce(override_days, requested_days, 30), 1), 365) AS ends FROM s LEFT JOIN j ON lower(j.url) = lower(s.url) AND j.company_id IS NOT DISTINCT FROM s.company_id AND j.source = 'community' AND j.is_active)
SELECT j.id, coalesce(m.title, j.title) AS title, coalesce(m.ends, j.expires_date) AS expires_date,
  CASE WHEN m.feature_days > 0 THEN CASE WHEN featured_at IS NOT NULL AND (featured_until IS NULL OR featured_until >= DATE '1998-01-01') THEN featured_at ELSE DATE '1998-01-01' END ELSE featured_at END AS featured_at,
  CASE WHEN m.feature_days > 0 THEN DATE '1998-01-01' + m.feature_days ELSE featured_until END AS featured_until, CASE WHEN m.id IS NULL THEN 'keep' ELSE 'refresh' END AS action FROM j LEFT JOIN m ON m.id = j.id
UNION ALL SELECT NULL, title, ends, CASE WHEN feature_days > 0 THEN DATE '1998-01-01' END, CASE WHEN feature_days > 0 THEN DATE '1998-01-01' + feature_days END, 'insert' FROM m WHERE id IS NULL""", "expires_date", "featured_at", "featured_until"))
def submission_approval(spark: SparkSession, d: str) -> DataFrame:
    """Postings after approved submissions: live community rows are refreshed, others inserted."""
    rows = table(spark, d, "orders").where("o_orderkey % 22 = 0 or o_orderkey % 50 = 1").selectExpr(
        "o_orderkey AS submission_id", "concat('https://board.example.com/jobs/', CAST(o_orderkey AS STRING)) AS url", "CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS company_id", "'New title' AS title",
        "CASE WHEN o_orderkey % 3 = 0 THEN 500 END AS override_days", "CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS requested_days", "CASE WHEN o_orderkey % 4 = 0 THEN 14 ELSE 0 END AS feature_days",
    )
    return as_text(moderation.approve_submissions(jobs(spark, d), rows, AS_OF).select("id", "title", "expires_date", "featured_at", "featured_until", "action"), "expires_date", "featured_at", "featured_until")


KIND = "CASE event_id % 6 WHEN 0 THEN 'relevant' WHEN 1 THEN 'not_relevant' WHEN 2 THEN 'expired' WHEN 3 THEN 'reopen' WHEN 4 THEN 'categories' ELSE 'feature' END"


@query(dated(f"""{WITH}, f AS (SELECT event_id AS feedback_id, event_id % 300 AS id, {KIND} AS kind FROM events),
g AS (SELECT id, max_by(kind, feedback_id) FILTER (WHERE kind IN ('relevant', 'not_relevant')) AS r, max_by(kind, feedback_id) FILTER (WHERE kind IN ('expired', 'reopen')) AS a, max(feedback_id) FILTER (WHERE kind = 'categories') AS c, max(feedback_id) FILTER (WHERE kind = 'feature') AS x FROM f GROUP BY 1)
SELECT j.id, CASE WHEN r IS NOT NULL THEN r = 'relevant' ELSE is_audio_related_override END AS related, CASE WHEN a IS NOT NULL THEN a = 'reopen' ELSE is_active_override END AS active,
CASE WHEN c IS NOT NULL THEN concat('tag', CAST(c % 7 AS VARCHAR)) ELSE array_to_string(categories_override, ',') END AS categories,
CASE WHEN x IS NULL THEN featured_at WHEN featured_at IS NOT NULL AND (featured_until IS NULL OR featured_until >= DATE '1998-01-01') THEN featured_at ELSE DATE '1998-01-01' END AS featured_at,
CASE WHEN x IS NULL THEN featured_until ELSE DATE '1998-01-01' + 10 END AS featured_until FROM j LEFT JOIN g ON g.id = j.id""", "featured_at", "featured_until"))
def feedback_approval(spark: SparkSession, d: str) -> DataFrame:
    """Postings after approved feedback of six kinds; the last of a kind counts."""
    rows = table(spark, d, "events").selectExpr("event_id AS feedback_id", "event_id % 300 AS id", f"{KIND} AS kind", f"CASE WHEN {KIND} = 'categories' THEN array(concat('tag', event_id % 7)) END AS suggested_categories", f"CASE WHEN {KIND} = 'feature' THEN 10 END AS days")
    out = moderation.approve_feedback(jobs(spark, d), rows, AS_OF)
    return as_text(out.select("id", c("is_audio_related_override").alias("related"), c("is_active_override").alias("active"), F.array_join("categories_override", ",").alias("categories"), "featured_at", "featured_until"), "featured_at", "featured_until")


@query(f"""{WITH}, s AS (SELECT event_id AS suggestion_id, user_id AS id, CASE WHEN event_id % 3 = 0 THEN concat('https://new', CAST(event_id AS VARCHAR), '.example.com') END AS careers_url, CASE WHEN event_id % 4 = 0 THEN 'https://forum.example.com' END AS link FROM events WHERE event_id % 5 = 0),
g AS (SELECT id, max_by(careers_url, suggestion_id) FILTER (WHERE careers_url IS NOT NULL) AS u, max(link) AS l FROM s GROUP BY 1)
SELECT k.id, coalesce(u, careers_url) AS careers_url, CASE WHEN l IS NOT NULL OR k.id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l IS NOT NULL AND k.id % 2 = 0 AND k.id % 4 <> 0 THEN 1 ELSE 0 END AS links, CASE WHEN g.id IS NOT NULL THEN 'manual' ELSE source END AS source FROM k LEFT JOIN g ON g.id = k.id""")
def suggestion_approval(spark: SparkSession, d: str) -> DataFrame:
    """Companies after approved suggestions; a link that a company has already is not added again."""
    rows = table(spark, d, "events").where("event_id % 5 = 0").selectExpr(
        "event_id AS suggestion_id", "user_id AS id", "CASE WHEN event_id % 3 = 0 THEN concat('https://new', event_id, '.example.com') END AS careers_url",
        "CASE WHEN event_id % 4 = 0 THEN named_struct('label', 'forum', 'url', 'https://forum.example.com') END AS link",
    )
    held = F.when(c("id") % 2 == 0, F.array(F.struct(F.lit("forum").alias("label"), F.when(c("id") % 4 == 0, "https://forum.example.com").otherwise("https://wiki.example.com").alias("url"))))
    out = moderation.approve_suggestions(companies(spark, d).withColumn("community_links", held), rows, ["careers_url"])
    return out.select("id", "careers_url", F.coalesce(F.size("community_links"), F.lit(0)).alias("links"), "source")


@query("""WITH s AS (SELECT o_orderkey AS sid, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'Sound engineer' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE 'https://x.example.com' END AS url, concat(' ', upper(c_name)) AS company_name, o_orderkey % 3 AS k, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT sid, c_custkey AS company_id, CASE WHEN trim(title) = '' THEN 'missing_title' WHEN url NOT LIKE 'http%' THEN 'bad_url' WHEN k = 0 THEN 'unknown_category' END AS problem FROM s""")
def submission_checks(spark: SparkSession, d: str) -> DataFrame:
    """Submissions with the company of their name, and what is wrong with them."""
    known = table(spark, d, "customer")
    rows = table(spark, d, "orders").join(known, c("c_custkey") == c("o_custkey")).selectExpr("o_orderkey AS sid", "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'Sound engineer' END AS title", "CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE 'https://x.example.com' END AS url", "concat(' ', upper(c_name)) AS company_name", "CASE WHEN o_orderkey % 3 = 0 THEN array('odd') ELSE array('mixing') END AS categories")
    return moderation.checked_submissions(rows, companies(spark, d), ["mixing", "mastering"]).select("sid", "company_id", "problem")


@query(f"""{WITH}, g AS (SELECT id FROM k WHERE id % 3 = 0) SELECT 'companies' AS name, count(*) AS n FROM k WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'jobs', count(*) FROM j WHERE company_id IS NULL OR company_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'log', count(*) FROM events WHERE user_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'detached', count(*) FROM orders WHERE o_custkey IN (SELECT id FROM g)""")
def cascaded_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table after companies are deleted; submissions stay without one."""
    all_ = companies(spark, d)
    out = moderation.delete_cascaded(all_, all_.where("id % 3 = 0"), "id", {"jobs": (jobs(spark, d), "company_id"), "log": (table(spark, d, "events"), "user_id")}, {"orders": (table(spark, d, "orders"), "o_custkey")})
    counts = [("companies", out["parents"]), ("jobs", out["jobs"]), ("log", out["log"]), ("detached", out["orders"].where("o_custkey is null"))]
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in counts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"""{WITH} SELECT id, CASE WHEN coalesce(verified, false) = false THEN 'unverified' WHEN coalesce(scrape_blocked, false) THEN 'blocked' WHEN consecutive_failures >= 3 THEN 'failing' WHEN id % 4 = 2 THEN 'never' ELSE 'ok' END AS state,
verified IS NOT DISTINCT FROM true AND careers_url IS NOT NULL AND scrape_blocked IS DISTINCT FROM true AS fetched FROM k""")
def company_states(spark: SparkSession, d: str) -> DataFrame:
    """How fetching stands for each company, and whether it is fetched at all."""
    rows = companies(spark, d)
    state = moderation.scrape_state(c("verified"), c("scrape_blocked"), c("consecutive_failures"), F.when(c("id") % 4 != 2, F.lit(date(1998, 1, 1))))
    chosen = cycle.population(rows).select("id", F.lit(True).alias("fetched"))
    return rows.join(chosen, "id", "left").select("id", state.alias("state"), F.coalesce("fetched", F.lit(False)).alias("fetched"))


@query("""SELECT o_orderkey, least(greatest(coalesce(o, r, 30), 1), 365) AS days, CASE WHEN o IS NOT NULL THEN 'override' WHEN r IS NOT NULL THEN 'requested' ELSE 'default' END AS origin
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INT) * 7 END AS o, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS INT) - 20 END AS r FROM orders)""")
def expiry_terms(spark: SparkSession, d: str) -> DataFrame:
    days, origin = money.expiry_days(c("o"), c("r"))
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INT) * 7 END AS o", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS INT) - 20 END AS r")
    return rows.select("o_orderkey", days.alias("days"), origin.alias("origin"))


@query(f"""{WITH}, f AS (SELECT id FROM k WHERE verified IS DISTINCT FROM true) SELECT j.id, CASE WHEN f.id IS NOT NULL AND source <> 'community' AND is_active THEN coalesce(is_active_override, false) ELSE is_active END AS is_active FROM j LEFT JOIN f ON f.id = company_id""")
def unverified_deactivation(spark: SparkSession, d: str) -> DataFrame:
    """Postings of companies that are not verified go off, unless an override keeps them."""
    gone = companies(spark, d).where(~c("verified").eqNullSafe(F.lit(True))).select("id")
    return cycle.deactivate(jobs(spark, d), gone).select("id", "is_active")


@query(f"{WITH} SELECT id, name FROM k ORDER BY priority DESC, lower(name) LIMIT 25")
def fetch_order(spark: SparkSession, d: str) -> DataFrame:
    return board.first_by(companies(spark, d), cycle.fetch_order(c("priority"), c("name")), 25).select("id", "name")


@query("""WITH t AS (SELECT p_partkey, replace(p_name, ' ', '-') AS s FROM part), u AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 THEN s || '-2' ELSE s END AS s FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM u), lit AS (SELECT DISTINCT s FROM u)
SELECT p_partkey, CASE WHEN n = 1 THEN s WHEN EXISTS (SELECT 1 FROM lit WHERE lit.s = r.s || '-2') THEN s || '-' || (n + 1) ELSE s || '-' || n END AS unique_slug FROM r""")
def slugs_skipping_used(spark: SparkSession, d: str) -> DataFrame:
    """Numbered slugs that skip a number which another row has by itself."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 9 = 4 THEN concat(replace(p_name, ' ', '-'), '-2') ELSE replace(p_name, ' ', '-') END AS slug")
    return history.unique_slugs(rows, "slug", ["p_partkey"]).select("p_partkey", "unique_slug")
