"""Rows from web pages: links, structured data, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_text

ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
HREF = r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']"


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for a link on a page; null for links that lead nowhere."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(href.rlike(r"(?i)^(?:#|mailto:|tel:|javascript:|data:)") | (href == ""), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, place, link, title) of every anchor, in page order."""
    found = pages.select(key, F.col(url).alias("base"), F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), 0)).alias("place", "anchor"))
    href, inner = F.trim(F.regexp_extract("anchor", HREF, 1)), page_text(F.regexp_extract("anchor", ANCHOR, 2))
    return found.select(key, "place", resolve(href, F.col("base")).alias("link"), inner.alias("title")).where("link is not null")


def best_titles(found: DataFrame, key: str = "page_id") -> DataFrame:
    """For each link of a page its longest title; the first of equals."""
    return found.groupBy(key, "link").agg(F.max_by("title", F.struct(F.length("title"), -F.col("place"))).alias("title"), F.min("place").alias("place"))


def structured_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, url, employment_type, date_posted) of the JSON-LD postings of each page; broken blocks are skipped."""
    block = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"
    raw = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(block), 1)).alias("json"))
    parsed = raw.select(key, F.try_parse_json("json").alias("v")).where("v is not null")
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))
    one = parsed.select(key, F.explode(listed).alias("p"))

    def text(path: str) -> Column:
        return F.try_variant_get("p", path, "string")

    kinds = F.coalesce(F.try_variant_get("p", "$['@type']", "array<string>"), F.array(text("$['@type']")))
    title = F.trim(text("$.title"))
    return one.where(F.array_contains(kinds, "JobPosting")).select(key, title.alias("title"), text("$.url").alias("url"), text("$.employmentType").alias("employment_type"), text("$.datePosted").alias("date_posted")).where("title <> ''")


def merge_found(anchors: DataFrame, structured: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors and structured rows by URL: structured values win, missing ones come from the anchor."""
    shared = [c for c in structured.columns if c in anchors.columns and c not in keys]
    a, s = anchors.select(*keys, *[F.col(c).alias(f"a_{c}") for c in shared]), structured.select(*keys, *[F.col(c).alias(f"s_{c}") for c in shared])
    return a.join(s, keys, "full_outer").select(*keys, *[F.coalesce(f"s_{c}", f"a_{c}").alias(c) for c in shared])
