"""What a page would give: found, normalised and summed up, with nothing stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import discovery, extract, pages
from .extract import LinkWords
from .keywords import Taxonomy
from .normalize import normalize
from .scoring import Lexicon

SAMPLES, LONG_DESCRIPTION = 5, 200


def dry_run(fetched: DataFrame, lexicon: Lexicon, valid: Sequence[str], taxonomy: Taxonomy | None = None, key: str = "page_id", words: LinkWords = LinkWords()) -> DataFrame:
    """One row a page: total, long_descriptions, board_rows, boards (those that it links to) and samples.

    fetched: key, url, html, audio_scope, company_category, company_name. Postings come from the page's linked data and
    from its links; of both for one URL the linked data's values count. Samples: rows for the board first, the best first.
    """
    c = F.col
    links = extract.page_postings(fetched, key, "url", "html", words).select(key, "url", "title", "job_type", "location", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("posted"))
    data = structured(fetched, key)
    both = pages.merge_found(links, data.select(key, "url", "title", "job_type", "location", "description", "posted"), [key, "url"])
    of = fetched.select(key, "audio_scope", "company_category", "company_name")
    raw = both.join(of, key).select(key, "title", "url", "description", "location", "job_type", F.to_date("posted").alias("posted_date"), F.lit(False).alias("remote_hint"), "audio_scope", "company_category", "company_name")
    rows = normalize(raw, lexicon, valid, taxonomy=taxonomy)
    order = F.struct((~c("is_audio_related")).alias("off"), (-c("relevance_score")).alias("score"), c("title"), c("url"))
    sample = F.slice(F.array_sort(F.collect_list(order)), 1, SAMPLES)  # a page's own postings
    said = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.length("description") >= LONG_DESCRIPTION).alias("long_descriptions"), F.count_if("is_audio_related").alias("board_rows"), F.transform(sample, lambda x: x["title"]).alias("samples"))
    found = discovery.discover(fetched, key, "html", "url").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "board", "slug"))), lambda x: F.concat_ws(":", x["board"], x["slug"])).alias("boards"))
    none = F.array().cast("array<string>")
    out = fetched.select(key, "url").join(said, key, "left").join(found, key, "left")
    return out.select(key, "url", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "long_descriptions", "board_rows")], F.coalesce("boards", none).alias("boards"), F.coalesce("samples", none).alias("samples"))


def structured(fetched: DataFrame, key: str) -> DataFrame:
    """(key, url, title, job_type, location, description, posted) of the postings in pages' linked data; without a URL the page's own counts."""
    blocks = extract.page_rows(fetched.select(key, "url", "html"), [key, "url"]).where("kind = 'data'").select(key, c_url := F.col("url"), F.try_parse_json("text").alias("v")).where("v is not null")
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))
    one = blocks.select(key, c_url, F.explode(listed).alias("p"))
    text = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("p", x, "string")), F.lit("")) for x in paths])
    kinds = F.coalesce(F.try_variant_get("p", "$['@type']", "array<string>"), F.array(text("$['@type']")))
    place = F.concat_ws(", ", *[text(f"$.jobLocation.address.{x}", f"$.jobLocation[0].address.{x}") for x in ("addressLocality", "addressRegion", "addressCountry")])
    rows = one.where(F.array_contains(kinds, "JobPosting")).select(
        key, F.coalesce(pages.resolve(text("$.url"), F.col("url")), F.col("url")).alias("url"), text("$.title").alias("title"), F.lower(F.replace(text("$.employmentType", "$.employmentType[0]"), F.lit("_"), F.lit("-"))).alias("job_type"),
        F.nullif(place, F.lit("")).alias("location"), text("$.description").alias("description"), text("$.datePosted").alias("posted"),
    ).where("title is not null")
    names = ("title", "job_type", "location", "description", "posted")
    return rows.groupBy(key, "url").agg(F.min(F.struct(*names)).alias("r")).select(key, "url", "r.*")
