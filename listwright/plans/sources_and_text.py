"""Queries of sources, pages and the functions on titles, texts and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text, titles, url
from ..operators import discovery, extract, pages
from ..sources.tables import dealt, document_text, flat_records, table
from .queries import AS_OF, query

c = F.col


# ---- titles ----

#: titles made of a part's words by its kind, in Spark's and DuckDB's SQL alike
TITLE_SQL = "CASE p_type WHEN 'ECONOMY' THEN concat(p_name, ' engineer ', CAST(p_size AS VARCHAR(9))) WHEN 'PROMO' THEN concat(p_name, ' jobs') WHEN 'SMALL' THEN concat('Browse ', p_name) WHEN 'MEDIUM' THEN concat(CAST(p_size AS VARCHAR(9)), ' open positions: ', p_name) WHEN 'LARGE' THEN concat('View all jobs in ', p_name) ELSE concat(CASE WHEN p_size > 25 THEN 'Senior ' ELSE 'Trainee ' END, p_name, ' praktikant') END"


@query(f"""WITH t AS (SELECT p_partkey, {TITLE_SQL} AS t FROM part), k AS (SELECT *, lower(t) AS low, regexp_matches(t, '(?i)\\bengineers?\\b') AS role_noun, len(string_split(t, ' ')) AS n FROM t)
SELECT p_partkey, role_noun, role_noun OR contains(low, 'praktikant') AS looks_like_role, NOT role_noun AND ((n > 1 AND n <= 5 AND regexp_matches(low, ' jobs$')) OR (n <= 6 AND regexp_matches(low, '^(browse|view)\\b'))) AS listing, contains(low, 'view all job') AS pointer,
n > 12 OR regexp_matches(low, '\\b\\d+ open positions\\b') AS furniture, regexp_replace(low, ' jobs$', '') IN ('red gear', 'hot rod') AS region, CASE WHEN regexp_matches(low, '\\b(trainee|praktikant)\\b') THEN 'internship' WHEN regexp_matches(low, '\\bsenior\\b') THEN 'senior' ELSE 'mid' END AS seniority FROM k""".replace("\\\\", "\\"))
def title_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What titles are: roles, labels of lists, parts of a page, regions; and their seniority."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{TITLE_SQL} AS t")
    t = c("t")
    return rows.select(
        "p_partkey", titles.has_role_noun(t).alias("role_noun"), titles.looks_like_role(t).alias("looks_like_role"), titles.is_listing_title(t).alias("listing"), titles.is_pointer(t).alias("pointer"),
        titles.is_furniture(t).alias("furniture"), titles.is_region_title(t, ["Red gear", "Hot rod"]).alias("region"), text.seniority(t).alias("seniority"),
    )


MESSY_SQL = "CASE p_type WHEN 'ECONOMY' THEN concat('Apply now: ', p_name, ' (m/w/d) | Full-time') WHEN 'PROMO' THEN upper(concat(p_name, ' for live ', p_brand, ' shows foh')) WHEN 'SMALL' THEN concat(p_name, ' - Remote, US') WHEN 'MEDIUM' THEN concat(p_name, ' (PDF)') WHEN 'LARGE' THEN concat(p_name, ', NY') ELSE concat(p_name, ' - Part time →') END"


@query("""WITH t AS (SELECT p_partkey, p_type, p_name, CASE p_type WHEN 'PROMO' THEN concat_ws(' ', upper(p_name[1]) || p_name[2:instr(p_name, ' ') - 1], upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:], 'For Live', p_brand, 'Shows FOH') ELSE p_name END AS plain FROM part)
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN plain || ' (m/w/d)' ELSE plain END AS title, CASE p_type WHEN 'ECONOMY' THEN 'Full-time' WHEN 'STANDARD' THEN 'Part time' END AS job_type, plain FROM t""")
def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without what lists and files put around them, the kind of employment that they ended with, and their marks of genders."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{MESSY_SQL} AS t").select("p_partkey", titles.clean_title(c("t")).alias("t"))
    return rows.select("p_partkey", "t.title", "t.job_type", text.strip_gender_markers(c("t.title")).alias("plain"))


@query("""WITH t AS (SELECT p_partkey, p_type, p_name || CASE WHEN p_size > 25 THEN ' night shift' ELSE '' END AS t, p_size > 25 AS night FROM part)
SELECT p_partkey, contains(t, 'bolt') AND NOT contains(t, 'small') AS clinical, night AND contains(t, 'ring') AND NOT contains(t, 'red') AS shift_work, p_type = 'ECONOMY' AND contains(t, 'gear') AS studio,
CASE p_type WHEN 'PROMO' THEN 'all' WHEN 'SMALL' THEN 'partial' WHEN 'LARGE' THEN 'partial' ELSE 'native' END AS scope,
CASE WHEN contains(replace(t, 'hot rod', ' '), 'plate') AND NOT contains(t, 'new') THEN replace(replace(t, 'hot rod', ' '), 'plate', ' ') ELSE replace(t, 'hot rod', ' ') END AS relevant FROM t""")
def title_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are vetoed or overridden, the scope of companies, and titles without misleading words."""
    t, category = F.concat("p_name", F.when(c("p_size") > 25, " night shift").otherwise("")), c("p_type")
    return table(spark, d, "part").select(
        "p_partkey", titles.is_clinical(t, r"(?i)\bbolt\b", r"(?i)\bsmall\b").alias("clinical"), titles.is_shift_work(t, r"(?i)\bring\b", [r"(?i)\bred\b"]).alias("shift_work"),
        titles.is_named_role(t, category, ["ECONOMY"], r"(?i)\bgear\b").alias("studio"), titles.scope_of(category, ["SMALL", "LARGE"], ["PROMO"]).alias("scope"),
        text.without_phrases(t, r"(?i)hot rod", r"(?i)\bplate\b", r"(?i)\bplate\b", r"(?i)\bnew\b").alias("relevant"),
    )


#: sentences about work from afar, with a part's name in them, by its kind
REMOTE_SQL = "CASE p_type WHEN 'ECONOMY' THEN concat('We make a ', p_name, '. This is a fully remote position.') WHEN 'PROMO' THEN concat('A ', p_name, ' role that is not a remote position.') WHEN 'SMALL' THEN concat('No ', p_name, '. Open to remote work in a team.') WHEN 'MEDIUM' THEN concat('We build remote ', p_name, ' tools.') WHEN 'LARGE' THEN concat('Location: Remote. ', p_name) ELSE concat('You will never have a remote role with a ', p_name, '. It is on site.') END"


@query("SELECT p_partkey, p_type IN ('ECONOMY', 'SMALL', 'LARGE') AS remote FROM part")
def remote_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions that offer remote work and do not deny it."""
    return table(spark, d, "part").selectExpr("p_partkey", f"{REMOTE_SQL} AS t").select("p_partkey", text.describes_remote(c("t")).alias("remote"))


# ---- texts ----


_ENTITIES = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


@query(f"""WITH p AS (SELECT page_id, html FROM pages)
SELECT page_id, trim(regexp_replace({_ENTITIES.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS plain,
len(regexp_extract_all({_ENTITIES.format('html')}, '(?s)<(p|li|ul|h[234]|strong|em|b|i|ol|br)\\b[^>]*>')) AS kept FROM p""".replace("\\\\", "\\"))
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages stripped of their tags, and how many tags a sanitized page keeps: all opening ones that are safe, none with an attribute."""
    rows = table(spark, d, "pages").select("page_id", text.strip_html(c("html")).alias("plain"), text.sanitize_html(c("html")).alias("safe"))
    return rows.select("page_id", "plain", (F.regexp_count("safe", F.lit("<[a-z0-9]+>")) + 1000 * F.regexp_count("safe", F.lit("<[a-z0-9]+ "))).cast("long").alias("kept"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USD 50k - 70k' WHEN 1 THEN 'EUR 900' WHEN 2 THEN '65k' END AS pay, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago' WHEN n < 30 THEN (n // 7) || CASE WHEN n // 7 > 1 THEN ' weeks ago' ELSE ' week ago' END ELSE (n // 30) || CASE WHEN n // 30 > 1 THEN ' months ago' ELSE ' month ago' END END AS ago FROM (SELECT o_orderkey, o_orderkey % 100 AS n FROM orders)""")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey") % 4
    low, high = F.when(k == 0, 50_000).when(k == 1, 900), F.when(k == 0, 70_000).when(k == 1, 900).when(k == 2, 64_600)
    day = F.date_sub(F.lit(AS_OF), (c("o_orderkey") % 100).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text.format_salary(low, high, F.when(k == 0, "USD").when(k == 1, "EUR")).alias("pay"), text.time_ago(day, F.lit(AS_OF)).alias("ago"))


@query("""SELECT c_custkey, 'customer,' || lower(split_part(c_name, '#', 2)) || ',customer' || lower(split_part(c_name, '#', 2)) AS tokens, 'we at   make things' AS said FROM customer""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of names with all of them as one, and texts without the names that speak for themselves."""
    said = F.concat(F.lit("we at "), F.upper("c_name"), F.lit(" make things"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.joined_tokens(c("c_name"), ["inc"]), ",").alias("tokens"), text.without_names(said, F.concat("c_name", F.lit(" (x)")), r"(?i)customer").alias("said"))


#: an order's day as boards write days, by its priority
DAY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN '2-HIGH' THEN date_format(o_orderdate, 'd MMM yyyy') WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN '4-NOT SPECIFIED' THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE concat(date_format(o_orderdate, 'EEE MMM dd HH:mm:ss'), ' UTC ', date_format(o_orderdate, 'yyyy')) END"


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted FROM orders")
def written_dates(spark: SparkSession, d: str) -> DataFrame:
    """The days of all orders, read from the forms that boards write them in."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{DAY_SQL} AS t")
    return rows.select("o_orderkey", money.written_date(c("t")).cast("string").alias("posted"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' <b>' ELSE p_name END AS content, CASE WHEN p_size < 20 THEN CAST(floor(p_retailprice) AS BIGINT) || ' - ' || (CAST(floor(p_retailprice) AS BIGINT) + p_size) || ' EUR / ' || lower(p_type) WHEN p_size < 40 THEN p_size || ' ' || p_brand END AS pay,
concat_ws(', ', p_name, CASE WHEN p_type <> p_name THEN p_type END) AS place FROM part""")
def odd_fields(spark: SparkSession, d: str) -> DataFrame:
    """Contents that may be base64, pay objects, and places of parts."""
    content = F.when(c("p_size") % 2 == 0, F.base64(F.concat("p_name", F.lit(" <b>")).cast("binary"))).otherwise(c("p_name"))
    low = F.floor("p_retailprice").cast("long")
    pay = F.when(c("p_size") < 20, F.to_json(F.struct(low.alias("min"), (low + c("p_size")).alias("max"), F.lit("EUR").alias("currency"), F.lower("p_type").alias("period")))).when(c("p_size") < 40, F.to_json(F.struct(c("p_size").alias("min"), c("p_brand").alias("currency")))).otherwise("{}")
    rows = table(spark, d, "part").select("p_partkey", money.decoded_content(content).alias("content"), F.parse_json(pay).alias("v"), money.joined_places([c("p_name"), F.concat(F.lit(" "), "p_type"), F.lit(None).cast("string"), c("p_name")]).alias("place"))
    return rows.select("p_partkey", "content", money.salary_text("v").alias("pay"), "place")


@query("""SELECT event_id, '{"event_id":' || event_id || ',"value":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '1.5' END || ',"site":"x"}' AS record FROM events""")
def flat_job_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows as records with where they came from; NaN becomes null."""
    rows = table(spark, d, "events").select("event_id", F.when(c("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(1.5).alias("value"))
    return flat_records(rows, site="x").select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), "record")


@query("""SELECT doc_id, CASE WHEN length(t) >= 200 THEN substr(t, 1, 20000) END AS body FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x{00A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)""")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Extracted texts of documents, tidied and bounded."""
    return table(spark, d, "documents").select("doc_id", document_text(c("text")).alias("body"))


# ---- URLs ----


@query("""SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS host0, 'example.' || split_part(regexp_extract(url, '://([^/?#:]*)', 1), '.', -1) AS domain, 'example' AS label, nullif(regexp_extract(url, 'utm_source=([^&#]*)', 1), '') AS source, length(regexp_extract(url, '://[^/]*([^#]*)', 1)) AS length, true AS below FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = c("url")
    rows = table(spark, d, "pages")
    base = F.regexp_extract(u, "^([a-z]+://[^/]*/[a-z]+)", 1)
    return rows.select("page_id", F.regexp_extract(u, "://([^/?#:]*)", 1).alias("host0"), url.registrable_domain(u).alias("domain"), url.registrable_label(u).alias("label"), url.query_value(u, "utm_source").alias("source"), url.path_length(u).alias("length"), url.same_or_below(u, base).alias("below"))


@query("""WITH k AS (SELECT c_custkey, split_part(c_name, '#', 2) AS n, lower(c_mktsegment) AS seg, lower(replace(n_name, ' ', '')) AS land, lower(n_name) AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, concat_ws(',', 'customer' || n, 'customer-' || n, seg, CASE WHEN land <> seg THEN land END) AS slugs, least(7 * 4 + 3, 24) AS candidates, 'https://boards.greenhouse.io/customer' || n AS first, 'https://s.example.com/jobs/' || regexp_replace(seg || '-' || nation, '[^a-z0-9]+', '-', 'g') || '-' || c_custkey AS made, length(nation) % 2 = 0 AS lost FROM k""")
def url_candidates(spark: SparkSession, d: str) -> DataFrame:
    """URLs to try for each company, made-up posting URLs, and redirects that lost the tenant."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), c("n_nationkey") == c("c_nationkey"))
    seg, land = F.lower("c_mktsegment"), F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    slugs = url.slug_candidates(c("c_name"), F.concat(F.lit("https://jobs."), seg, F.lit(".com/x")), F.concat(F.lit("https://"), land, F.lit(".org")))
    final = F.concat(F.lit("https://jobs.lever.co/"), F.when(F.length("n_name") % 2 == 0, "").otherwise(land))
    made = url.posting_url("https://s.example.com/jobs/", F.concat("c_mktsegment", F.lit(" / "), "n_name"), c("c_custkey"))
    rows = rows.select("c_custkey", slugs.alias("s"), made.alias("made"), url.lost_identity(F.concat(F.lit("https://jobs.lever.co/"), land), final).alias("lost"))
    found = url.url_candidates(c("s"), F.lit("https://example.com/home"))
    return rows.select("c_custkey", F.array_join("s", ",").alias("slugs"), F.size(found).alias("candidates"), found[0].alias("first"), "made", "lost")


@query("""WITH e AS (SELECT event_id, '10.' || user_id % 256 || '.0.' || event_id % 256 AS peer, '203.0.' || user_id % 256 || '.' || length(props) AS outer_, event_type FROM events)
SELECT event_id, event_id % 256 AS last, CASE WHEN event_type IN ('click', 'view') THEN outer_ ELSE peer END AS client, split_part(peer, '.', 2)::INT < 64 AS near FROM e""")
def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Who sent a request behind trusted proxies, and membership in a network."""
    peer = F.concat(F.lit("10."), c("user_id") % 256, F.lit(".0."), c("event_id") % 256)
    forwarded = F.when(c("event_type").isin("click", "view"), F.concat(F.lit("198.51.100.1, 203.0."), c("user_id") % 256, F.lit("."), F.length("props"), F.lit(", 10.1.1.1")))
    client = url.client_address(forwarded, peer, ["10.0.0.0/8"])
    return table(spark, d, "events").select("event_id", (url.ip_number(peer) % 256).alias("last"), client.alias("client"), url.in_networks(peer, ["10.0.0.0/10"]).alias("near"))


# ---- pages ----


@query("""WITH t AS (SELECT p_partkey, p_type, replace(p_name, ' ', '-') AS slug, p_size FROM part)
SELECT p_partkey, 'lever' AS board, slug FROM t WHERE p_type <> 'PROMO' UNION ALL SELECT p_partkey, 'recruitee', slug || '-' || p_size FROM t WHERE p_type IN ('SMALL', 'PROMO') UNION ALL SELECT p_partkey, 'workday', 't' || p_size || '.wd3/' || slug FROM t WHERE p_type = 'LARGE'""")
def board_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Boards that pages link to; content hosts are no tenants."""
    slug, kind = F.replace("p_name", F.lit(" "), F.lit("-")), c("p_type")
    html = F.concat(
        F.when(kind != "PROMO", F.concat(F.lit('<a href="https://jobs.lever.co/'), F.initcap(slug), F.lit('">x</a>'))).otherwise(""), F.lit('<img src="https://cdn.recruitee.com/a.png">'),
        F.when(kind.isin("SMALL", "PROMO"), F.concat(F.lit('<a href="https://'), slug, F.lit("-"), "p_size", F.lit('.recruitee.com/o/1">y</a>'))).otherwise(""),
        F.when(kind == "LARGE", F.concat(F.lit('<a href="https://t'), "p_size", F.lit(".wd3.myworkdayjobs.com/en-us/"), slug, F.lit('">z</a>'))).otherwise(""),
    )
    return discovery.discover(table(spark, d, "part").select("p_partkey", html.alias("html")), "p_partkey").select("p_partkey", "board", "slug")


@query("""WITH t AS (SELECT p_partkey, p_type, replace(p_name, ' ', '-') AS slug, p_size FROM part), held AS (SELECT DISTINCT slug FROM t WHERE p_size < 3), full_ AS (SELECT DISTINCT slug FROM t WHERE p_type = 'ECONOMY')
SELECT p_partkey, 'lever' AS board, slug FROM t WHERE p_type <> 'PROMO' AND slug NOT IN (SELECT slug FROM held) AND slug IN (SELECT slug FROM full_)""")
def new_bindings(spark: SparkSession, d: str) -> DataFrame:
    """First findings that are supported, free, and gave postings."""
    rows = table(spark, d, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("-")))
    html = F.concat(F.lit('<a href="https://jobs.'), F.when(c("p_type") == "PROMO", "unknown.com/").otherwise("lever.co/"), "slug", F.lit('">x</a>'))
    held = rows.where("p_size < 3").select(F.lit("lever").alias("board"), F.upper("slug").alias("slug"))
    verified = rows.select(F.lit("lever").alias("board"), "slug", F.when(c("p_type") == "ECONOMY", c("p_size")).otherwise(0).alias("postings"))
    return discovery.new_bindings(discovery.discover(rows.select("p_partkey", html.alias("html")), "p_partkey"), held, ["lever"], verified, "p_partkey")


@query("""WITH t AS (SELECT p_partkey, 'https://' || lower(p_type) || '.example.com' AS root, replace(p_name, ' ', '-') AS slug, p_size FROM part)
SELECT p_partkey, concat_ws(',', root || '/careers/' || slug, 'https://jobs.lever.co/' || slug) AS links, CASE WHEN p_size % 2 = 0 THEN root || '/list?page=' || (p_size + 1) ELSE root || '/' || slug || '-2' END AS next FROM t""")
def careers_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page that look like careers, and the page that a listing goes on with."""
    slug, root = F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com"))
    more = F.when(c("p_size") % 2 == 1, F.concat(F.lit('<a class="n" rel="next" href="/'), slug, F.lit('-2">Next</a>'))).otherwise("")
    html = F.concat(F.lit('<a href="/careers/'), slug, F.lit('">C</a><a href="/about">A</a><a href="https://facebook.com/jobs">F</a><a href="https://jobs.lever.co/'), slug, F.lit('">B</a><a href="/careers/'), slug, F.lit('">C</a>'), more)
    rows = dealt(table(spark, d, "part").select("p_partkey", F.concat(root, F.lit("/list?page="), "p_size").alias("url"), html.alias("html")), "p_partkey")
    found = discovery.careers_links(rows, "p_partkey").select("p_partkey", F.array_join("links", ",").alias("links"))
    return found.join(rows.select("p_partkey", discovery.next_link(c("html"), c("url")).alias("next")), "p_partkey")


@query("""WITH r AS (SELECT o_custkey AS listing, o_orderkey % 6 AS page, o_orderkey % 4 AS item, o_orderkey FROM orders), p AS (SELECT DISTINCT listing, page FROM r),
f AS (SELECT listing, item, min(page) AS first FROM r GROUP BY ALL), n AS (SELECT DISTINCT listing, first AS page FROM f),
s AS (SELECT p.listing, min(p.page) FILTER (WHERE n.page IS NULL) AS stop FROM p LEFT JOIN n USING (listing, page) GROUP BY 1)
SELECT f.listing, f.item, f.first AS page FROM f JOIN s USING (listing) WHERE first <= 4 AND (stop IS NULL OR first < stop)""")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """Rows of paged listings until a page brings nothing new."""
    rows = table(spark, d, "orders").selectExpr("o_custkey AS listing", "o_orderkey % 6 AS page", "o_orderkey % 4 AS item").withColumn("key", F.concat_ws("-", "listing", "page"))
    return discovery.collect_pages(rows, "listing", "page", "item", "key", 4).select("listing", "item", "page")


#: what a probe of an event met: pages by the kind of event, errors and statuses by its value
PROBE_SQL = "CASE WHEN value < 2 THEN 'please verify you are human' WHEN value < 4 THEN concat('careers at https://jobs.lever.co/u', CAST(user_id AS VARCHAR(9))) WHEN value < 6 THEN concat('jobs at https://u', CAST(user_id AS VARCHAR(9)), '.breezy.hr') WHEN value < 8 THEN concat('careers of ', event_type, ': no open positions') WHEN value < 10 THEN concat('hello ', event_type) WHEN value < 14 THEN 'jobs! add to cart' WHEN value < 20 THEN 'careers <div id=\"root\">' ELSE concat('our careers ', event_type) END"


@query(f"""WITH e AS (SELECT event_id, event_type, value, user_id, CASE WHEN event_type = 'view' THEN 200 + CAST(floor(value * 20) AS INT) % 300 ELSE 200 END AS status FROM events)
SELECT event_id AS company_id, CASE WHEN event_type = 'error' THEN 'unreachable' WHEN status IN (401, 403, 405, 406, 429) THEN 'blocked' WHEN status >= 400 THEN 'dead_url' WHEN value < 2 THEN 'blocked' WHEN value < 4 THEN 'ats_discoverable' WHEN value < 6 THEN 'ats_unsupported' WHEN value < 8 THEN 'no_openings' WHEN value < 10 THEN 'not_a_careers_page' WHEN value < 14 THEN 'storefront' WHEN value < 20 THEN 'js_rendered' ELSE 'unknown' END AS bucket,
CASE WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'tls' WHEN value < 20 THEN 'timeout' ELSE 'odd ' || user_id END WHEN status >= 400 THEN 'http ' || status WHEN value < 2 THEN 'verify you are human' WHEN value < 4 THEN 'lever' WHEN value < 6 THEN 'breezy' WHEN value < 8 THEN 'no open positions' WHEN value < 10 THEN 'no careers vocabulary' WHEN value < 14 THEN 'add to cart' WHEN value < 20 THEN 'id="root"' ELSE '' END AS detail FROM e""")
def failure_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why pages gave nothing: the first of fourteen rules that holds."""
    none, value = F.array().cast("array<string>"), c("value")
    error = F.when(value < 10, "SSL certificate expired").when(value < 20, "connection timed out").otherwise(F.concat(F.lit("odd "), "user_id"))
    status = F.when(c("event_type") == "view", 200 + F.floor(value * 20).cast("int") % 300).otherwise(200)
    rows = table(spark, d, "events").select(
        c("event_id").alias("company_id"), F.lit("https://x.example.com/p").alias("url"), F.lit("https://x.example.com/p").alias("final_url"), status.cast("int").alias("status"), F.expr(PROBE_SQL).alias("html"),
        none.alias("links"), none.alias("json_endpoints"), F.lit(0).alias("job_link_count"), F.when(c("event_type") == "error", error).alias("error"),
    )
    return discovery.diagnose(rows, ["lever"], "company_id")


@query("""WITH t AS (SELECT p_partkey, 'We like ' || p_name || ' people: an open application is welcome from ' || lower(p_type) || ' to ' || p_brand || ' and beyond.' AS said, p_size FROM part),
x AS (SELECT p_partkey, p_size, said || CASE WHEN p_size % 3 = 0 THEN ' No openings at this time' ELSE ' ' || p_size || ' jobs' END AS t FROM t)
SELECT p_partkey AS page_id, 'open application' AS marker, trim(substr(t, greatest(instr(t, 'open application') - 80, 1), instr(t, 'open application') - greatest(instr(t, 'open application') - 80, 1) + 16 + 80)) AS context, p_size % 3 = 0 AS no_openings FROM x WHERE p_size % 5 <> 0""")
def open_application_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages that invite to apply without a posting."""
    said = F.concat(F.lit("<p>We like <b>"), "p_name", F.lit("</b> people: an open application is welcome from "), F.lower("p_type"), F.lit(" to "), "p_brand", F.lit(" and beyond.</p><p>"), F.when(c("p_size") % 3 == 0, "No openings at this time").otherwise(F.concat("p_size", F.lit(" jobs"))), F.lit("</p>"))
    html = F.when(c("p_size") % 5 == 0, F.when(c("p_size") % 2 == 0, F.concat(said, F.lit(" access denied"))).otherwise(c("p_name"))).otherwise(said)
    return discovery.open_applications(table(spark, d, "part").select(c("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "marker", "context", "no_openings")


@query("""SELECT p_partkey, 'Title ' || p_name || ' ' || p_type AS body, p_name AS panel, trim(repeat(p_type || ' ', 80)) AS said, 'https://x.example.com/' || p_partkey AS link, p_brand AS place, concat_ws('; ', p_brand, CASE WHEN p_type <> p_brand THEN p_type END) AS listed FROM part""")
def page_trees(spark: SparkSession, d: str) -> DataFrame:
    """Main texts, fold-outs, and places beside links, of a page for each part."""
    html = F.concat(
        F.lit("<nav>no</nav><main><h1>Title</h1> "), "p_name", F.lit(" <p>"), "p_type", F.lit("</main><details><summary>"), "p_name", F.lit("</summary><p>"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(80)),
        F.lit('</p></details><details><summary>short</summary>no</details><div class="card"><a href="/'), "p_partkey", F.lit('">A</a><span class="job-location"> '), "p_brand", F.lit(', </span></div><div><a href="/b">B</a></div>'),
    )
    rows = extract.page_rows(dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", "p_brand", "p_type", html.alias("html")), ["p_partkey", "p_brand", "p_type"])
    one = rows.groupBy("p_partkey", "p_brand", "p_type").agg(
        F.max(F.when(c("kind") == "main", c("text"))).alias("body"), F.max(F.when(c("kind") == "panel", c("heading"))).alias("panel"), F.max(F.when(c("kind") == "panel", c("text"))).alias("said"),
        F.max(F.when(c("kind") == "link", F.when(c("location").isNotNull(), F.struct("href", "location")))).alias("l"),
    )
    return one.select("p_partkey", "body", "panel", "said", pages.resolve(c("l.href"), F.lit("https://x.example.com/list")).alias("link"), c("l.location").alias("place"), money.listed_places(F.array("p_brand", F.concat(F.lit(" "), "p_type"), "p_brand")).alias("listed"))
