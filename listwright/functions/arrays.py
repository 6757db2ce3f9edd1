"""Array columns: URL lists, link lists, set algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URLS, MAX_LINKS = 6, 10


def _key(u: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(u), r"/+$", ""))


def distinct_urls(urls: Column, skip: Column | None = None) -> Column:
    """http(s) URLs in order, each once whatever its case and closing slashes, without `skip`; null if none is left."""
    web = F.filter(F.transform(urls, lambda x: F.trim(x)), lambda u: u.rlike(r"(?i)^https?://"))
    if skip is not None:
        web = F.filter(web, lambda u: _key(u) != F.coalesce(_key(skip), F.lit("")))
    first = F.filter(web, lambda u, i: F.array_position(F.transform(web, _key), _key(u)) == i + 1)
    return F.when(F.size(first) > 0, first)


def fetch_urls(primary: Column, extra: Column, limit: int = MAX_URLS) -> Column:
    """The primary URL, then the others, each once."""
    named = F.filter(F.concat(F.array(F.coalesce(F.trim(primary), F.lit(""))), F.coalesce(F.transform(extra, lambda x: F.trim(x)), F.array().cast("array<string>"))), lambda u: u != "")
    return F.slice(F.filter(named, lambda u, i: F.array_position(F.transform(named, _key), _key(u)) == i + 1), 1, limit)


def valid_links(json: Column, limit: int = MAX_LINKS) -> Column:
    """Links {label, url} of a JSON array: trimmed, with a label and a web address; null if none is left."""
    parsed = F.from_json(json, "array<struct<label:string,url:string>>")
    clean = F.transform(parsed, lambda x: F.struct(F.trim(x["label"]).alias("label"), F.trim(x["url"]).alias("url")))
    kept = F.slice(F.filter(clean, lambda x: (x["label"] != "") & x["url"].rlike(r"(?i)^https?://")), 1, limit)
    return F.when(F.size(kept) > 0, kept)


def append_link(links: Column, link: Column) -> Column:
    """The links with one more, unless its URL is there."""
    have = F.coalesce(links, F.array().cast("array<struct<label:string,url:string>>"))
    return F.when(F.exists(have, lambda x: x["url"] == link["url"]), have).otherwise(F.concat(have, F.array(link)))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def with_domain(categories: Column, domain: Column, label_only: Column) -> Column:
    """Categories with the company's domain, unless it is there or all of them are mere labels; sorted."""
    keep = domain.isNull() | F.array_contains(categories, domain) | ((F.size(categories) > 0) & subset(categories, label_only))
    return F.when(keep, categories).otherwise(F.array_sort(F.array_union(categories, F.array(domain))))
