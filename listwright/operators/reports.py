"""Reports: grouped proposals, bindings, link checks, and how they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .health import truncated
from .resolve import normalize_name, related

SAMPLES = 3


def first_values(rows: DataFrame, key: str, value: str, order: str, n: int, name: str) -> DataFrame:
    """(key, name): each group's first n distinct values in order; tasks send n of a group at most."""
    from pyspark.sql import Window

    first = rows.where(F.trim(value) != "").groupBy(key, F.trim(value).alias("__v")).agg(F.min(order).alias("__at"))
    ranked = first.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__at", "__v"))).where(F.col("__r") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias(name))


def candidates(rows: DataFrame, place: str, name: str = "company_name", sets: Sequence[str] = ("search_term", "country"), samples: dict[str, int] | None = None, first: Sequence[str] = ("company_url",), key: str | None = None) -> DataFrame:
    """One row a company that the rows name, by its normalised name.

    name is the commonest spelling, the first met of equals, then the least; hit_count the rows; a sorted distinct array of each of the
    sets, the first few of each of the samples, and the first value of the others. key: a column with the normalised names, if
    the rows have them.
    """
    keyed = rows.withColumn("__key", F.col(key) if key else normalize_name(F.col(name))).where("__key <> ''")
    spelled = keyed.groupBy("__key", F.trim(name).alias("__name")).agg(F.count("*").alias("n"), F.min(place).alias("__at"))
    shown = spelled.groupBy("__key").agg(F.min_by("__name", F.struct(-F.col("n"), "__at", "__name")).alias("name"))
    arrays = [F.array_sort(F.collect_set(F.nullif(F.trim(s), F.lit("")))).alias(f"{s}s") for s in sets]
    ones = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(place))).alias(f) for f in first]
    out = keyed.groupBy("__key").agg(F.count("*").alias("hit_count"), *arrays, *ones).join(shown, "__key")
    for column, n in (samples or {}).items():
        out = out.join(first_values(keyed, "__key", column, place, n, f"{column}s"), "__key", "left")
    return out.withColumnRenamed("__key", "normalized_name")


def rank_candidates(found: DataFrame, least: int, limit: int | None = None, terms: str = "search_terms") -> DataFrame:
    rows = found.where(F.col("hit_count") >= least).orderBy(F.col("hit_count").desc(), F.size(terms).desc(), F.lower("name").asc())
    return rows if limit is None else rows.limit(limit)


def binding_audit(companies: DataFrame, supported: Sequence[str], ignored: Sequence[str] = ("jobs", "careers", "board", "external", "en", "us")) -> DataFrame:
    """(id, name, problems, shared_with, priority) of bound companies (id, name, careers_url, ats_type, ats_slug).

    Problems: empty_slug, unknown_ats, duplicate_binding, slug_unrelated. Opaque slugs, of digits and hex alone, are
    related to anyone.
    """
    slug = F.coalesce(F.trim("ats_slug"), F.lit(""))
    rows = companies.where("ats_type is not null").withColumn("__slug", slug)
    shared = rows.where("__slug <> ''").groupBy("ats_type", "__slug").agg(F.count("*").alias("__n")).where("__n > 1")
    rows = rows.join(shared, ["ats_type", "__slug"], "left")
    tokens = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "careers_url")), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    parts = F.filter(F.split(F.lower("__slug"), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*ignored) & ~w.rlike(r"^wd\d+$"))
    opaque = F.lower("__slug").rlike(r"^[0-9a-f-]{16,}$|^\d+$")
    named = (F.col("__slug") == "") | opaque | related(tokens, parts)
    problems = F.array_compact(
        F.array(
            F.when(F.col("__slug") == "", "empty_slug"), F.when(~F.col("ats_type").isin(*supported), "unknown_ats"), F.when(F.col("__n").isNotNull(), "duplicate_binding"), F.when(~named, "slug_unrelated"),
        )
    )
    out = rows.select("id", "name", problems.alias("problems"), (F.coalesce("__n", F.lit(1)) - 1).alias("shared_with"))
    return out.withColumn("priority", F.arrays_overlap("problems", F.array(F.lit("empty_slug"), F.lit("duplicate_binding"))))


def binding_order() -> list[Column]:
    return [F.size("problems").desc(), F.col("priority").desc(), F.lower("name").asc()]


def truncation(metrics: DataFrame, jobs: DataFrame, caps: dict[str, int], company: str = "company_id") -> DataFrame:
    """Sources at their method's cap with active and board rows, the emptiest boards first."""
    counts = jobs.groupBy(company).agg(F.count_if("is_active").alias("active_jobs"), F.count_if(F.col("is_active") & F.col("is_audio_related")).alias("board_jobs"))
    out = truncated(metrics, caps).join(counts, company, "left").fillna(0, ["active_jobs", "board_jobs"])
    return out.orderBy(F.col("board_jobs").asc(), F.col("jobs_found").desc(), F.col(company).asc())


def by_url(rows: DataFrame, url: str, order: str, ids: str, most: int = 20) -> DataFrame:
    """(url, ids, place, n): each URL once with its first `most` rows' ids in order, by first appearance, and the number of all."""
    few = first_values(rows.withColumn("__id", F.col(ids).cast("string")), url, "__id", order, most, "ids")
    return rows.groupBy(url).agg(F.min(order).alias("place"), F.count("*").alias("n")).join(few, url)


def sample_order(on_board: Column, score: Column, id_: Column) -> list[Column]:
    """Rows on the board first, the highest scores first."""
    return [on_board.desc(), score.desc_nulls_last(), id_.asc()]


def write_json(report: DataFrame, path: str) -> None:
    """A report as JSON lines; the committer replaces the folder as a whole."""
    report.write.mode("overwrite").json(path)


def as_markdown(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line) a Markdown table row for each row; the header is `markdown_header`."""
    cell = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in columns]
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))


def markdown_header(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def script_json(value: Column) -> Column:
    """A struct as JSON that may stand in a page's script: no `<` in it ends or opens a tag."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def posting_data(title: Column, description: Column, posted: Column, company: Column, place: Column, url: Column) -> Column:
    """A posting as linked data; what is missing is left out."""
    where = F.when(place.isNotNull(), F.struct(F.lit("Place").alias("@type"), place.alias("address")))
    by = F.when(company.isNotNull(), F.struct(F.lit("Organization").alias("@type"), company.alias("name")))
    return script_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), title.alias("title"), description.alias("description"), posted.cast("string").alias("datePosted"), by.alias("hiringOrganization"), where.alias("jobLocation"), url.alias("url")))


def sitemap_rows(rows: DataFrame, url: str, changed: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, line) of a sitemap's <url> elements, addresses escaped; the caller's writer puts them between the head and the end."""
    safe = F.col(url)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    day = F.coalesce(F.concat(F.lit("<lastmod>"), F.col(changed).cast("string"), F.lit("</lastmod>")), F.lit(""))
    return rows.select(*keys, F.concat(F.lit("<url><loc>"), safe, F.lit("</loc>"), day, F.lit("</url>")).alias("line"))
