"""Queries through the stored indexes: word search by posting lists, pages by rank ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search as words
from ..operators import board, ranked_pages, search_index
from ..sources.work import work_dir
from .listings import BOARD_SQL, SEEN, SHOWN, _board, _page_sql
from .queries import query

c = F.col
#: texts that are searched for: whole words, prefixes, marks, words of the headline and of the body, nothing found
ASKED = ("Bolt, promo", "brand#1", "econo", "senior widget", "engineer role", "gear zzz", "#12 small", "red")


def _met(term: str, column: str) -> str:
    escaped = "".join("\\" + ch if not ch.isalnum() else ch for ch in term)
    return f"regexp_matches(coalesce({column}, ''), '(?i)(^|[^a-z0-9]){escaped}" + ("($|[^a-z0-9])" if len(term) <= words.WHOLE_WORD_LENGTH else "") + "')"


def _search_sql(text: str) -> str:
    terms = words.terms(text)
    every = " AND ".join(f"({' OR '.join(_met(t, x) for x in ('title', 'company_name', 'description'))})" for t in terms)
    head = " AND ".join(f"({' OR '.join(_met(t, x) for x in ('title', 'company_name'))})" for t in terms)
    return f"SELECT '{text}' AS asked, id, CASE WHEN {head} THEN 0 ELSE 1 END AS rank FROM f WHERE {every}"


@query(f"{BOARD_SQL}, f AS (SELECT * FROM l WHERE is_active AND listable) " + " UNION ALL ".join(_search_sql(t) for t in ASKED))
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """What several texts find among all postings on the board, through the index."""
    rows = board.filter_jobs(_board(spark, d), board.JobFilter(include_unrelated=True)).select("id", "title", "company_name", "description")
    index = search_index.build(rows, work_dir(spark, "search-index"), "id", ["title", "company_name"], ["description"])
    out = None
    for text in ASKED:
        found = search_index.search(spark, index, text).select(F.lit(text).alias("asked"), "id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


#: (sort, its SQL, page, size) of pages that are read through rank indexes; types unknown come last in one of them
PAGES = (
    ("newest", f"{SEEN} DESC NULLS LAST, created_at DESC NULLS LAST", 37, 20, False), ("oldest", f"{SEEN} ASC NULLS LAST, created_at ASC NULLS LAST", 1, 50, False),
    ("salary_desc", f"coalesce(salary_max, salary_min, 0) DESC, {SEEN} DESC NULLS LAST", 5, 100, False), ("salary_asc", f"job_type IS NULL, coalesce(salary_max, salary_min, 1000000000), {SEEN} DESC NULLS LAST", 9, 30, True),
)


@query(" UNION ALL ".join(f"SELECT '{sort}' AS sort, * FROM ({_page_sql('is_audio_related', order, size, number, 'job_type IS NULL' if tail else 'false')})" for sort, order, number, size, tail in PAGES))
def ranked_board_pages(spark: SparkSession, d: str) -> DataFrame:
    """Deep pages of several sorts, each from the ranges of its rank index that it lies in."""
    rows = board.filter_jobs(_board(spark, d), board.JobFilter())
    out = None
    for sort, _, number, size, tail in PAGES:
        order = board.job_order(sort, untyped_last=tail)
        index = ranked_pages.build(rows, order, work_dir(spark, f"rank-{sort}"), c("job_type").isNull() if tail else None, range_rows=500)
        got = ranked_pages.page(spark, index, order, number, size).select(F.lit(sort).alias("sort"), *SHOWN, "total", "pages")
        out = got if out is None else out.unionByName(got)
    return out
