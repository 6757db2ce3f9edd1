"""The driver's tables as tables of the domain: postings from orders and parts, companies from customers.

The column lists are plain SQL that Spark and DuckDB read alike; queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

JOB_COLUMNS = """o_orderkey AS id, CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey END AS company_id,
concat(CASE o_orderkey % 4 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' ELSE '' END, p_name, ' engineer') AS title, concat(p_type, ' ', p_brand, ' role') AS description,
concat('https://board.example.com/jobs/', CAST(o_orderkey AS VARCHAR(20))) AS url, concat('x', CAST(o_orderkey AS VARCHAR(20))) AS external_id,
CASE WHEN o_orderkey % 11 = 0 THEN 'community' ELSE 'scraper' END AS source, o_orderstatus <> 'P' AS is_active,
CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 17 = 0 THEN false END AS is_active_override, o_orderkey % 3 <> 0 AS is_audio_related,
CASE WHEN o_orderkey % 23 = 0 THEN true END AS is_audio_related_override,
CASE o_orderkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'entry' WHEN 2 THEN 'mid' END AS seniority,
CASE o_orderpriority WHEN '1-URGENT' THEN 'full-time' WHEN '2-HIGH' THEN 'part-time' WHEN '3-MEDIUM' THEN 'contract' END AS job_type,
CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote, concat('City ', CAST(o_orderkey % 40 AS VARCHAR(20))) AS location,
CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 < 3 THEN 'DE' ELSE 'US' END AS country,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 4) AS INT) END AS salary_min, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 4) AS INT) + 20000 END AS salary_max,
split(p_name, ' ') AS job_categories, CASE WHEN o_orderkey % 31 = 0 THEN split(p_type, ' ') END AS categories_override,
CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_date, o_orderdate AS created_at,
CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderdate AS DATE) END AS featured_at, CASE WHEN o_orderkey % 38 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS featured_until,
CAST(o_orderdate AS DATE) + 60 AS expires_date, CAST(o_orderkey % 101 AS INT) AS relevance_score"""
JOBS_SQL = f"SELECT {JOB_COLUMNS} FROM orders JOIN part ON p_partkey = o_orderkey % 200"

COMPANY_COLUMNS = """c_custkey AS id, c_name AS name, replace(lower(c_name), '#', '-') AS slug, CAST(c_custkey % 6 AS INT) AS consecutive_failures,
CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS verified, CASE WHEN c_custkey % 9 <> 0 THEN concat('https://c', CAST(c_custkey AS VARCHAR(20)), '.example.com/careers') END AS careers_url,
CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS scrape_blocked, c_mktsegment AS category, CASE WHEN c_custkey % 3 = 0 THEN 'native' ELSE 'partial' END AS audio_scope,
c_custkey % 5 = 0 AS open_application, c_custkey % 10 = 0 AS priority, CASE WHEN c_custkey % 8 = 0 THEN 'manual' ELSE 'seed' END AS source,
CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' END AS ats_type, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('slot-', CAST(c_custkey % 40 AS VARCHAR(20))) END AS ats_slug"""
COMPANIES_SQL = f"SELECT {COMPANY_COLUMNS} FROM customer"


def _selected(rows: DataFrame, columns: str) -> DataFrame:
    return rows.sparkSession.sql(f"SELECT {columns} FROM {{rows}}", rows=rows)


def jobs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr("*", "o_orderkey % 200 AS p_partkey")
    return _selected(orders.join(table(spark, d, "part"), "p_partkey"), JOB_COLUMNS)


def companies(spark: SparkSession, d: str) -> DataFrame:
    return _selected(table(spark, d, "customer"), COMPANY_COLUMNS)
