"""Queries of stored state: cycles that rewrite what they touch, scores worked out where something changed, renames, relatedness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles
from ..operators import board, keywords, lifecycle, proposals, renames, reports, requests, rescore, resolve, scoring, seed, store
from ..sources.tables import table
from ..sources.work import work_dir
from ..streaming import sinks
from .fixtures import COMPANIES_SQL, JOBS_SQL, companies, jobs
from .listings import SEEN, SHOWN, _board, _page_sql
from .queries import LEXICON, query

c = F.col
STORED = ["company_id", "external_id", "title", "is_active", "is_active_override"]


@query(f"""WITH j AS ({JOBS_SQL}), s AS (SELECT company_id, external_id, title, coalesce(is_active, false) AS is_active, is_active_override, id FROM j WHERE company_id IS NOT NULL),
f AS (SELECT company_id, external_id, upper(title) AS title FROM s WHERE company_id % 50 = 7 AND id % 2 = 0 UNION ALL SELECT DISTINCT company_id, 'new' AS external_id, 'New post' AS title FROM s WHERE company_id % 50 = 7),
m AS (SELECT coalesce(s.company_id, f.company_id) AS company_id, coalesce(s.external_id, f.external_id) AS external_id, coalesce(f.title, s.title) AS title, s.company_id IS NULL AS added, f.company_id IS NOT NULL AS seen, s.is_active, s.is_active_override FROM s FULL JOIN f USING (company_id, external_id))
SELECT company_id, external_id, title, CASE WHEN added THEN true WHEN seen AND NOT is_active AND coalesce(is_active_override, true) THEN true WHEN company_id % 50 = 7 AND NOT seen AND is_active AND NOT coalesce(is_active_override, false) THEN false ELSE is_active END AS is_active FROM m""")
def stored_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The stored table after a cycle over a fiftieth of the companies, which rewrites their buckets only."""
    rows = jobs(spark, d).where("company_id is not null").select(*STORED, "id").withColumn("is_active", F.coalesce("is_active", F.lit(False)))
    kept = store.Store(work_dir(spark, "stored-jobs"), "company_id", 64)
    kept.create(rows.select(*STORED))
    mine = rows.where("company_id % 50 = 7")
    fetched = mine.where("id % 2 = 0").select("company_id", "external_id", F.upper("title").alias("title")).unionByName(mine.select("company_id", F.lit("new").alias("external_id"), F.lit("New post").alias("title")).distinct())
    outcomes = mine.select("company_id", F.lit(False).alias("trust_empty"), F.lit(True).alias("allow_deactivation")).distinct()
    kept.update(fetched, lambda old: lifecycle.reconcile(old, fetched, outcomes, ["company_id", "external_id"], ["title"]))
    return kept.read(spark).select("company_id", "external_id", "title", "is_active")


TAXONOMY = keywords.Taxonomy(LEXICON.strong, LEXICON.weak, rules=(keywords.Rule("raises", "make", r"\bsenior\b"),))


@query(f"WITH j AS ({JOBS_SQL}), k AS ({COMPANIES_SQL}) SELECT j.id, j.id % 10 <> 0 AND k.id % 20 <> 3 AS skipped FROM j JOIN k ON j.company_id = k.id")
def rescored_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Which rows keep their scores after titles and companies' scopes have changed (tested against scoring all again)."""
    now, own = jobs(spark, d), companies(spark, d)
    before = now.withColumn("title", F.when(c("id") % 10 == 0, F.concat(F.lit("Old "), "title")).otherwise(c("title")))
    were = own.withColumn("audio_scope", F.when(c("id") % 20 == 3, F.lit("all")).otherwise(c("audio_scope")))
    path = work_dir(spark, "scores")
    rescore.rescored(before, were, LEXICON, TAXONOMY).write.parquet(path)
    return rescore.rescored(now, own, LEXICON, TAXONOMY, spark.read.parquet(path)).select("id", "skipped")


@query("""WITH a AS (SELECT * FROM documents WHERE doc_id % 2 = 0), b AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
a1 AS (SELECT lower(trim(text)) AS v, min(doc_id) AS old FROM a WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) = 1), b1 AS (SELECT lower(trim(text)) AS v, min(doc_id) AS new FROM b WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) = 1),
an AS (SELECT n_chars AS v, min(doc_id) AS old FROM a GROUP BY 1 HAVING count(*) = 1), bn AS (SELECT n_chars AS v, min(doc_id) AS new FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT old, new, 3.0::DOUBLE AS score, 'text' AS by FROM a1 JOIN b1 USING (v) UNION ALL SELECT old, new, 2.0::DOUBLE, 'n_chars' FROM an JOIN bn USING (v)""")
def rename_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What even documents share with odd ones and with no other: their text, or its length."""
    docs = table(spark, d, "documents")
    return renames.evidence(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", {"text": 3, "n_chars": 2})


@query("""WITH k AS (SELECT c_custkey AS company, [x for x in [lower(n_name), lower(c_mktsegment), 'firm' || c_custkey % 30] if length(x) >= 3] AS own FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey AS binding, s_suppkey % 150 AS owner, [x for x in [substr(lower(n_name), 1, 6), substr(lower(n_name), 2, 4), 'firm' || s_suppkey % 40] if length(x) >= 3] AS own FROM supplier JOIN nation ON n_nationkey = s_nationkey),
st AS (SELECT binding, owner, unnest(own) AS t FROM s), kt AS (SELECT company, unnest(own) AS u FROM k),
p AS (SELECT DISTINCT t, u FROM (SELECT DISTINCT t FROM st), (SELECT DISTINCT u FROM kt) WHERE t = u OR (least(length(t), length(u)) >= 4 AND (contains(t, u) OR contains(u, t))) OR (least(length(t), length(u)) >= 5 AND left(t, 5) = left(u, 5))),
m AS (SELECT DISTINCT binding, owner, company FROM st JOIN p USING (t) JOIN kt USING (u))
SELECT s.binding, s.owner, coalesce(bool_or(m.company = s.owner), false) AS own_related, min(m.company) FILTER (WHERE m.company <> s.owner) AS other FROM s LEFT JOIN m ON m.binding = s.binding AND m.owner = s.owner GROUP BY 1, 2""")
def related_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Whether bindings are related to their own companies, and the least other one that they are related to."""
    nation = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    long = lambda *parts: F.filter(F.array(*parts), lambda x: F.length(x) >= 3)
    own = table(spark, d, "customer").join(nation, c("n_nationkey") == c("c_nationkey")).select(c("c_custkey").alias("company"), long("n", F.lower("c_mktsegment"), F.concat(F.lit("firm"), c("c_custkey") % 30)).alias("names"))
    held = table(spark, d, "supplier").join(nation, c("n_nationkey") == c("s_nationkey")).select(c("s_suppkey").alias("binding"), (c("s_suppkey") % 150).alias("owner"), long(F.substring("n", 1, 6), F.substring("n", 2, 4), F.concat(F.lit("firm"), c("s_suppkey") % 40)).alias("tokens"))
    return resolve.related_companies(held, own, "binding", "owner", "tokens", "company", "names")


ASKED = "https://x.example.com/jobs?q=Bolt&category=bolt,large&category=gear&salary_min=0&seniority=senior&seniority=mid,&unknown=1&page=2&per_page=7"


@query(_page_sql("is_audio_related AND (regexp_matches(coalesce(title, ''), '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') OR regexp_matches(coalesce(company_name, ''), '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') OR regexp_matches(coalesce(description, ''), '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])')) AND seniority IN ('senior', 'mid') AND list_has_any(job_categories, ['bolt', 'large', 'gear'])", f"CASE WHEN regexp_matches(title, '(?i)(^|[^a-z0-9])bolt($|[^a-z0-9])') THEN 0 ELSE 1 END, {SEEN} DESC NULLS LAST, created_at DESC NULLS LAST", 7, 2))
def requested_board(spark: SparkSession, d: str) -> DataFrame:
    """The page of the board that a request's URL asks for."""
    asked = requests.board_params(ASKED)
    rows = board.filter_jobs(_board(spark, d), requests.board_filter(asked))
    return board.page(rows, board.job_order(asked.get("sort", "newest"), search=asked.get("search")), int(asked["page"]), int(asked["per_page"])).select(*SHOWN, "total", "pages")


@query(f"""WITH j AS ({JOBS_SQL}) SELECT id, '<url><loc>' || replace(url || '?a=1&b=<2>', '&', '&amp;') || '</loc>' || coalesce('<lastmod>' || CAST(posted_date AS VARCHAR) || '</lastmod>', '') || '</url>' AS line,
'{{"@context":"https://schema.org","@type":"JobPosting","title":"' || title || ' \\u003cb>"' || coalesce(',"datePosted":"' || CAST(posted_date AS VARCHAR) || '"', '') || ',"jobLocation":{{"@type":"Place","address":"' || location || '"}}}}' AS data FROM j""".replace("replace(url || '?a=1&b=<2>', '&', '&amp;')", "replace(replace(replace(url || '?a=1&b=<2>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"))
def posting_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap elements and linked data of postings, safe to stand in pages."""
    rows = jobs(spark, d).withColumn("address", F.concat("url", F.lit("?a=1&b=<2>")))
    none = F.lit(None).cast("string")
    data = reports.posting_data(F.concat("title", F.lit(" <b>")), none, c("posted_date"), none, c("location"), none)
    return reports.sitemap_rows(rows.withColumn("data", data), "address", "posted_date", ["id", "data"])


@query("""WITH e AS (SELECT user_id, ts, event_type = 'error' AS failed, event_id, max(event_id) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id) AS last FROM events)
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) FILTER (WHERE failed AND (last IS NULL OR event_id > last)) AS failures FROM e GROUP BY 1""")
def failures_by_batches(spark: SparkSession, d: str) -> DataFrame:
    """Failures since the last success of each user, counted in three batches of which the second comes twice."""
    sink = sinks.FailureCounts(work_dir(spark, "failure-counts"), "user_id", "failed", "event_id")
    rows = table(spark, d, "events").select("user_id", (c("event_type") == "error").alias("failed"), "event_id")
    cut = rows.approxQuantile("event_id", [0.4, 0.7], 0.01)
    parts = (rows.where(c("event_id") < cut[0]), rows.where((c("event_id") >= cut[0]) & (c("event_id") < cut[1])), rows.where(c("event_id") >= cut[1]))
    for i, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        sink(part, i)
    return sink.read(spark)


@query("""WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 4 * 3600 * 1000000::BIGINT, true) AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS begins, CAST(epoch_us(max(ts)) AS BIGINT) AS ends, count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions: stretches of events with four hours at most between neighbours."""
    found = sinks.sessions(table(spark, d, "events"), "user_id", "ts", "4 hours")
    return found.select("user_id", F.unix_micros(c("begins")).alias("begins"), F.unix_micros(c("ends")).alias("ends"), "n")


SEED_COLUMNS = ("careers_url", "category", "verified", "scrape_blocked", "open_application", "priority", "ats_type", "ats_slug")
#: entries of all customers: what they say of a company, and which of it they say at all
SEED_SQL = """SELECT c_custkey AS place, CASE WHEN c_custkey % 3 = 1 THEN concat(c_name, ' New') ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('https://s', CAST(c_custkey AS VARCHAR(20)), '.example.org') END AS careers_url,
CASE WHEN c_acctbal > 5000 THEN 'MACHINERY' ELSE c_mktsegment END AS category, c_acctbal > 0 AS verified, CASE WHEN c_nationkey % 5 = 0 THEN true END AS scrape_blocked, c_nationkey % 4 = 0 AS open_application, c_nationkey % 7 = 0 AS priority,
CASE WHEN c_nationkey % 2 = 0 THEN 'lever' END AS ats_type, concat('t', CAST(c_nationkey AS VARCHAR(9))) AS ats_slug, c_custkey % 4 AS says FROM customer"""
_SAID = {"careers_url": (0, 1, 2), "category": (0, 1), "verified": (0, 2), "scrape_blocked": (1,), "open_application": (0, 1, 2, 3), "priority": (2,), "ats_type": (0, 3), "ats_slug": (0, 3)}


@query(f"""WITH k AS ({COMPANIES_SQL}), e AS ({SEED_SQL}), m AS (SELECT e.*, k.id FROM e LEFT JOIN k ON lower(k.name) = lower(e.name)),
n AS (SELECT k.id, k.name, source, {', '.join(f"CASE WHEN m.id IS NOT NULL AND source <> 'manual' AND says IN ({', '.join(map(str, says))}) THEN m.{x} ELSE k.{x} END AS {x}" for x, says in _SAID.items())}, k.category AS was, audio_scope, m.id IS NOT NULL AND source <> 'manual' AS writable, CASE WHEN m.id IS NULL THEN 'keep' WHEN source = 'manual' THEN 'protected' ELSE 'update' END AS action FROM k LEFT JOIN m ON m.id = k.id)
SELECT id, name, {', '.join(SEED_COLUMNS)}, CASE WHEN writable AND category IS DISTINCT FROM was THEN CASE WHEN category = 'MACHINERY' THEN 'all' WHEN category = 'BUILDING' THEN 'partial' ELSE 'native' END ELSE audio_scope END AS audio_scope, action FROM n
UNION ALL SELECT NULL, name, {', '.join(SEED_COLUMNS)}, CASE WHEN category = 'MACHINERY' THEN 'all' WHEN category = 'BUILDING' THEN 'partial' ELSE 'native' END, 'insert' FROM m WHERE id IS NULL""")
def seed_load_all(spark: SparkSession, d: str) -> DataFrame:
    """Companies after a seed of all columns; the scope follows a changed category."""
    rows = spark.sql(SEED_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))
    present = F.array_compact(F.array(*[F.when(c("says").isin(*says), x) for x, says in _SAID.items()]))
    entries = rows.select("place", "name", *SEED_COLUMNS, present.alias("present"))
    loaded = seed.load(entries, companies(spark, d), SEED_COLUMNS, {"audio_scope": ("category", lambda x: titles.scope_of(x, ["BUILDING"], ["MACHINERY"]))})
    return loaded.select("id", "name", *SEED_COLUMNS, "audio_scope", "action")


#: found postings are titles of parts at companies of segments and nations; known are those of one segment
PROPOSED = scoring.Lexicon(strong={}, weak={}, title_strong=r"(?i)\bbolt")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS place, l_quantity, c_mktsegment, n_name, concat(c_mktsegment, ' Works ', n_name, CASE WHEN l_quantity > 25 THEN ' GmbH' ELSE ' Ltd' END) AS company_name, p_name AS title, o_orderpriority AS term
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%bolt%'),
k AS (SELECT *, lower(c_mktsegment || ' works ' || replace(n_name, '_', ' ')) AS key FROM f WHERE c_mktsegment <> 'BUILDING'),
s AS (SELECT key, company_name, count(*) AS n, min(place) AS pos FROM k GROUP BY ALL)
SELECT key AS normalized_name, (SELECT company_name FROM s WHERE s.key = k.key ORDER BY n DESC, pos, company_name LIMIT 1) AS name, count(*) AS hit_count, array_to_string(list_sort(list(DISTINCT term)), ',') AS search_terms FROM k GROUP BY key HAVING count(*) >= 2""")
def proposed_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies of relevant postings that are not known by any spelling."""
    parts = table(spark, d, "part").select("p_partkey", c("p_name").alias("title"), c("p_type").alias("description"))
    parts = proposals.with_texts(parts, proposals.relevant_texts(parts, PROPOSED, keywords.Taxonomy({})))
    rows = table(spark, d, "lineitem").join(parts, c("p_partkey") == c("l_partkey")).join(table(spark, d, "orders"), c("o_orderkey") == c("l_orderkey"))
    rows = rows.join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey")).join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"))
    none = F.lit(None).cast("string")
    name = F.concat("c_mktsegment", F.lit(" Works "), "n_name")
    found = rows.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("place"), F.concat(name, F.when(c("l_quantity") > 25, " GmbH").otherwise(" Ltd")).alias("company_name"), "title", "description", none.alias("location"), c("o_orderpriority").alias("search_term"), none.alias("country"), none.alias("company_url"))
    known = table(spark, d, "nation").select(F.concat(F.lit("Building works "), "n_name", F.lit(" Inc.")).alias("name"))
    out = proposals.of_relevant(found, known, least=2)
    return out.select("normalized_name", "name", "hit_count", F.array_join("search_terms", ",").alias("search_terms"))
