"""Finding boards and careers pages, and telling why a page gave nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import page_text
from .history import first_wins
from .pages import resolve

#: fixed values: how a board's links name its tenant, in order: (board, pattern, groups that make the slug)
BOARD_LINKS = (
    ("greenhouse", r"boards(?:\.[a-z]{2,4})?\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?([a-z0-9_-]+)", (1,)),
    ("lever", r"jobs\.lever\.co/([a-z0-9_-]+)", (1,)),
    ("workable", r"apply\.workable\.com/([a-z0-9_-]+)", (1,)),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_-]+)", (1,)),
    ("smartrecruiters", r"careers\.smartrecruiters\.com/([a-z0-9_-]+)", (1,)),
    ("recruitee", r"([a-z0-9-]+)\.recruitee\.com", (1,)),
    ("workday", r"([a-z0-9]+\.wd\d+)\.myworkdayjobs\.com(?:/[a-z]{2}-[a-z]{2})?/([a-z0-9_-]+)", (1, 2)),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com/careers", (1,)),
    ("breezy", r"([a-z0-9-]+)\.breezy\.hr", (1,)),
    ("pinpoint", r"([a-z0-9-]+)\.pinpointhq\.com", (1,)),
    ("haileyhr", r"([a-z0-9-]+)\.careers\.haileyhr\.app", (1,)),
    ("adp", r"myjobs\.adp\.com/([a-z0-9_]+)", (1,)),
    ("adp", r"workforcenow\.adp\.com/[^\s\"'<>]{1,200}[?&]cid=([0-9a-f-]{36})", (1,)),
    ("icims", r"([a-z0-9-]+)\.icims\.com", (1,)),
    ("apple", r"jobs\.apple\.com()", (1,)),
    ("eightfold", r"eightfold\.ai()", (1,)),
)
#: fixed values: boards without a tenant, boards whose tenant is the page's own domain, and second labels that registrations stand below
NO_SLUG, SLUG_OF_PAGE, SECOND_LABELS = ("apple",), ("eightfold",), ("co", "com", "net", "org", "ac", "gov", "edu")
#: fixed values: subdomains that are no tenants
NO_TENANTS = ("analytics", "api", "assets", "cdn", "help", "static", "support", "www")
MOST_LINKS = 6
#: hosts whose links are noise on any page
#: fixed values: what content hosts begin or end with
CONTENT_BEGINS, CONTENT_ENDS = ("assets", "static", "cdn", "img", "images", "media", "files", "analytics"), ("cdn", "assets", "analytics")
NOISE_HOSTS = ("facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com", "glassdoor.com")


def registered_domain(url: Column) -> Column:
    """The part of a URL's host that is registered: its last two labels, or three below a shared second one."""
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))
    shared = F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(*SECOND_LABELS) & (F.length(F.substring_index(host, ".", -1)) == 2)
    return F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def discover(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """(key, board, slug, place): the boards that a page links to, each once, in the order of the patterns and then of the page.

    url: the column of the page's own URL, which names the tenant for some boards; without it they are not found.
    """
    parts = [_matches(html, pattern, groups, board, number) for number, (board, pattern, groups) in enumerate(BOARD_LINKS)]
    own = registered_domain(F.col(url)) if url else F.lit("")
    rows = pages.select(key, own.alias("__own"), F.explode(F.concat(*parts)).alias("m")).select(key, "__own", "m.*")
    rows = rows.withColumn("slug", F.when(F.col("board").isin(*SLUG_OF_PAGE), F.col("__own")).otherwise(F.col("slug")))
    first, last = F.regexp_extract("slug", "^([a-z]+)[-.]", 1), F.regexp_extract("slug", "[-.]([a-z]+)$", 1)
    path = F.col("slug").contains("/")  # a tenant with its site is none of the content hosts
    content = ~path & (F.col("slug").isin(*NO_TENANTS) | first.isin(*CONTENT_BEGINS) | last.isin(*CONTENT_ENDS)) & ~F.col("board").isin(*SLUG_OF_PAGE)
    plain = rows.where(~content & ((F.col("slug") != "") | F.col("board").isin(*NO_SLUG)))
    return plain.groupBy(key, "board", "slug").agg(F.min(F.struct("number", "at")).alias("place"))


def _matches(html: str, pattern: str, groups: Sequence[int], board: str, number: int) -> Column:
    pattern_, text = F.lit(pattern), F.lower(html)
    slugs = F.regexp_extract_all(text, pattern_, groups[0])
    if len(groups) > 1:
        slugs = F.zip_with(slugs, F.regexp_extract_all(text, pattern_, groups[1]), lambda a, b: F.concat(a, F.lit("/"), b))
    return F.transform(slugs, lambda s, i: F.struct(F.lit(board).alias("board"), s.alias("slug"), F.lit(number).alias("number"), i.alias("at")))


def first_discovery(found: DataFrame, key: str = "page_id") -> DataFrame:
    return found.groupBy(key).agg(F.min_by(F.struct("board", "slug"), "place").alias("b")).select(key, "b.*")


def new_bindings(found: DataFrame, companies: DataFrame, supported: Sequence[str], verified: DataFrame, key: str) -> DataFrame:
    """(key, board, slug) of first findings that are supported, that no company holds and that gave postings when read.

    companies: (id, board, slug) held; verified: (board, slug, postings).
    """
    first = first_discovery(found, key).where(F.col("board").isin(*supported))
    held = companies.where("slug is not null").select("board", F.lower("slug").alias("slug")).distinct()
    full = verified.where("postings > 0").select("board", "slug").distinct()
    return first.join(held, ["board", "slug"], "left_anti").join(full, ["board", "slug"], "left_semi").select(key, "board", "slug")


def careers_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limit: int = MOST_LINKS) -> DataFrame:
    """(key, links): the first links of a page that look like careers pages or boards, each once, in page order."""
    href = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#]+)"), 1)
    absolute = F.filter(F.transform(href, lambda h: resolve(F.trim(h), F.col(url))), lambda u: u.isNotNull() & u.rlike("(?i)^https?://"))

    def wanted(u: Column) -> Column:
        host = U.host_of(u)
        return (U.path_of(u).rlike(U.CAREERS_WORDS) | U.is_board_host(host)) & ~host.isin(*NOISE_HOSTS)

    return pages.select(key, F.slice(F.array_distinct(F.filter(absolute, wanted)), 1, limit).alias("links"))


def next_link(html: Column, base: Column) -> Column:
    """The page that a listing goes on with: rel=next, a link labelled so, else the page number after this one's."""
    rel = F.regexp_extract(html, r"(?is)<(?:a|link)\b[^>]*\brel\s*=\s*[\"']next[\"'][^>]*>", 0)
    named = F.regexp_extract(html, r"(?is)<a\b[^>]*>\s*(?:next(?: page)?|older|»|›)\s*</a\s*>", 0)
    tag = F.coalesce(F.nullif(rel, F.lit("")), F.nullif(named, F.lit("")))
    href = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']([^\"']+)", 1)
    return F.coalesce(resolve(F.nullif(href, F.lit("")), base), U.next_page(base))


def collect_pages(rows: DataFrame, listing: str, page: str, identity: str, page_id: str, limit: int = 10) -> DataFrame:
    """Rows of a listing's pages as reading on until nothing new comes would have them: each identity at its first page.

    Reading ends before a page of a key met before, before one without new rows, and at `limit` pages.
    """
    first = rows.groupBy(listing, identity).agg(F.min(page).alias("__first"))
    new = first.groupBy(listing, F.col("__first").alias(page)).agg(F.count("*").alias("__new"))
    keys = rows.groupBy(listing, page_id).agg(F.min(page).alias("__seen"))
    pages = rows.select(listing, page, page_id).distinct().join(keys, [listing, page_id]).join(new, [listing, page], "left")
    stops = pages.groupBy(listing).agg(F.min(F.when((F.col("__seen") < F.col(page)) | F.col("__new").isNull(), F.col(page))).alias("__stop"))
    kept = rows.join(stops, listing).where((F.col(page) <= limit) & (F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))))
    return first_wins(kept.drop("__stop"), F.struct(listing, identity), [page])


# ---- why a page gave nothing ----

#: fixed values: statuses of guarded sites
BLOCKED_STATUSES = (401, 403, 405, 406, 429, 999)
#: words in errors and pages, by what they tell
ERROR_WORDS = (("tls", "(?i)certificate|ssl|tls"), ("dns", "(?i)name or service|getaddrinfo|name_not_resolved|nodename"), ("timeout", "(?i)time[d ]*out"))
CAPTCHA, BLOCK_WORDS, BLOCK_PAGE = "(?i)captcha|challenge-platform|/sorry/", ("access denied", "verify you are human", "request blocked", "attention required"), 20_000
NO_OPENINGS = ("no open positions", "no current openings", "no vacancies", "no openings at this time", "not currently hiring")
STOREFRONTS = ("add to cart", "shopping cart", "checkout", "your basket")
LOGINS = ("sign in to continue", "log in to continue", "forgot password")
SCRIPT_APPS = ("__next_data__", "id=\"root\"", "id=\"app\"", "ng-app", "enable javascript")
INVITATION = r"(?i)(?:send us your (?:cv|resume|résumé)|open application|spontaneous application|speculative application|always looking for talent)"
CONTEXT = 80


def _first_word(text: Column, words: Sequence[str]) -> Column:
    """The first of the words, in their order, that the text contains; null if none."""
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(0))


def is_storefront(text: Column) -> Column:
    return _first_word(F.lower(text), STOREFRONTS).isNotNull()


def is_login(text: Column) -> Column:
    return _first_word(F.lower(text), LOGINS).isNotNull()


def has_careers_words(text: Column) -> Column:
    return F.coalesce(text.rlike(U.CAREERS_WORDS), F.lit(False))


def invitation(text: Column) -> tuple[Column, Column]:
    """(words, context) of the first invitation to apply without a posting; nulls without one."""
    marker = F.nullif(F.regexp_extract(text, INVITATION, 0), F.lit(""))
    at = F.instr(text, marker)
    begin = F.greatest(at - CONTEXT, F.lit(1))
    return marker, F.trim(F.substr(text, begin, at - begin + F.length(marker) + CONTEXT))


def open_applications(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, marker, context, no_openings) of pages that invite to apply and are not blocked."""
    marker, context = invitation(F.col("__text"))
    rows = pages.select(key, page_text(F.col(html)).alias("__text"))
    blocked = _first_word(F.lower("__text"), BLOCK_WORDS).isNotNull()
    return rows.where(~blocked).select(key, marker.alias("marker"), context.alias("context"), _first_word(F.lower("__text"), NO_OPENINGS).isNotNull().alias("no_openings")).where("marker is not null")


def diagnose(probes: DataFrame, supported: Sequence[str], key: str = "company_id") -> DataFrame:
    """(key, bucket, detail) of page probes (url, final_url, status, html, links, json_endpoints, job_link_count, error): the first rule that holds.

    Buckets: unreachable, blocked, dead_url, ats_discoverable, ats_unsupported, offsite_careers, json_endpoint, no_openings,
    not_a_careers_page, storefront, extractor_gap, careers_landing, js_rendered, unknown.
    """
    c = F.col
    text = F.concat_ws("\n", c("html"), F.array_join("links", "\n"))
    boards = discover(probes.select(key, text.alias("__all")), key, "__all")
    known = boards.groupBy(key).agg(F.min_by("board", F.when(c("board").isin(*supported), c("place"))).alias("__board"), F.min_by("board", F.when(~c("board").isin(*supported), c("place"))).alias("__other"))
    rows = probes.join(known, key, "left").withColumn("__low", F.lower(F.coalesce("html", F.lit(""))))
    error = F.coalesce(*[F.when(c("error").rlike(p), name) for name, p in ERROR_WORDS], F.substring("error", 1, 80))
    status = F.concat(F.lit("http "), c("status"))
    block = F.when(F.length("html") < BLOCK_PAGE, _first_word(c("__low"), BLOCK_WORDS))
    off, deeper = U.offsite_careers_link(c("links"), c("url")), U.deeper_careers_link(c("links"), c("url"))
    endpoint = F.get(F.filter("json_endpoints", U.is_job_endpoint), F.lit(0))
    shop, closed, app = _first_word(c("__low"), STOREFRONTS), _first_word(c("__low"), NO_OPENINGS), _first_word(c("__low"), SCRIPT_APPS)
    rules = (
        ("unreachable", c("error").isNotNull(), error),
        ("blocked", c("status").isin(*BLOCKED_STATUSES), status),
        ("dead_url", c("status") >= 400, status),
        ("blocked", F.concat_ws(" ", "url", "final_url").rlike(CAPTCHA), F.lit("captcha redirect")),
        ("blocked", block.isNotNull(), block),
        ("ats_discoverable", c("__board").isNotNull(), c("__board")),
        ("ats_unsupported", c("__other").isNotNull(), c("__other")),
        ("offsite_careers", off.isNotNull(), off),
        ("json_endpoint", endpoint.isNotNull(), endpoint),
        ("no_openings", closed.isNotNull(), closed),
        ("not_a_careers_page", ~has_careers_words(c("__low")), F.lit("no careers vocabulary")),
        ("storefront", shop.isNotNull() & (c("job_link_count") == 0), shop),
        ("extractor_gap", c("job_link_count") > 0, F.concat(c("job_link_count"), F.lit(" links extracted"))),
        ("careers_landing", deeper.isNotNull(), deeper),
        ("js_rendered", app.isNotNull(), app),
    )
    bucket, detail = F.lit("unknown"), F.lit("")
    for name, holds, said in reversed(rules):
        holds = F.coalesce(holds, F.lit(False))
        bucket, detail = F.when(holds, name).otherwise(bucket), F.when(holds, said).otherwise(detail)
    return rows.select(key, bucket.alias("bucket"), detail.alias("detail"))

