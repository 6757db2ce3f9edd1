"""Board payloads as posting rows.

A board is a set of parts: small functions from a posting (a variant column) to a column. `at` reads the first path with
a value, `joined`, `each` and `template` put several together, `mapped` translates. Templates may name columns of the
payload's own row besides, its tenant: the host or slug that a board's public URLs need. A payload may be JSON, JSON
inside a page, a page of links, or Markdown; a detail payload of a posting adds what its listing leaves out.

Everything runs as column expressions, so a frame of any number of payloads is one narrow pass. Parts name a value many
times; what they ask of a posting are columns first (`Reading`), read once a posting.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dates import parse_date, relative_date
from ..functions.money import decoded_content, written_date
from ..functions.text import page_text, unescape
from ..operators.normalize import fenced

FIELDS = ("title", "url", "external_id", "location", "description", "job_type", "posted_date", "remote_hint")


# ---- parts ----


def _steps(path: str) -> tuple[str | int, ...]:
    """`$.a.b[0]` is a, b, 0."""
    found = re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)
    if "$" + "".join(f".{name}" if name else f"[{i}]" for name, i in found) != path:
        raise ValueError(f"{path} is no path of names and numbers")
    return tuple(name or int(i) for name, i in found)


class Reading:
    """A posting as parts get it in place of its variant: what they ask of it are names of columns, which `columns` adds.

    All that is asked for is taken from the payload in one go, as a struct of its own type, not path by path from a
    variant of each item. Items of a posting's arrays are variants still.
    """

    def __init__(self, inner: str = "$") -> None:
        self.inner = _steps(inner)
        self.values: dict[tuple[tuple[str | int, ...], str], str] = {}
        self.made: dict[Part, tuple[str, Column]] = {}

    def value(self, path: str, kind: str) -> Column:
        return F.col(self.values.setdefault((self.inner + _steps(path), kind), f"__value{len(self.values)}"))

    def part(self, part: Part) -> Column:
        if part not in self.made:
            made = part(self)  # parts that it is made of come first
            self.made[part] = f"__part{len(self.made)}", made
        return F.col(self.made[part][0])

    def type(self, place: tuple[str | int, ...] = ()) -> str:
        """Of what is at the place, with all that is asked for at it and below; a variant if that is asked for in several ways."""
        n = len(place)
        kinds = {kind for steps, kind in self.values if steps == place}
        below = list(dict.fromkeys(steps[n] for steps, _ in self.values if len(steps) > n and steps[:n] == place))
        if not below and len(kinds) == 1:
            return {"text": "string", "said": "variant"}.get(kind := kinds.pop(), kind)
        if not kinds and all(isinstance(x, int) for x in below) and len({self.type((*place, x)) for x in below}) == 1:
            return f"array<{self.type((*place, below[0]))}>"
        # names of a struct differ in more than capitals
        if not kinds and all(isinstance(x, str) for x in below) and len({x.lower() for x in below}) == len(below):
            return "struct<" + ",".join(f"`{x}`:{self.type((*place, x))}" for x in below) + ">"
        return "variant"

    def _found(self, item: Column, steps: tuple[str | int, ...], kind: str) -> Column:
        for n, step in enumerate(steps):
            if self.type(steps[:n]) == "variant":
                return value(item, "$" + "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in steps[n:]), kind)
            item = F.get(item, F.lit(step)) if isinstance(step, int) else item.getField(step)
        return value(item, "$", kind) if self.type(steps) == "variant" != kind else stripped(item) if kind == "text" else item

    def columns(self, rows: DataFrame, item: str, keep: list[str]) -> DataFrame:
        """The rows' columns `keep` and all that was asked for of the item, none of it worked out anew by what stands above."""
        rows = rows.select(*keep, *[self._found(F.col(item), steps, kind).alias(name) for (steps, kind), name in self.values.items()])
        for name, made in self.made.values():
            rows = rows.withColumn(name, made)
        return fenced(rows)


Part = Callable[[Column | Reading], Column]


def stripped(text: Column) -> Column:
    """The text without white space at its ends; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(" \t\n\r\x0b\x0c\u00a0")), F.lit(""))


def value(p: Column | Reading, path: str, kind: str) -> Column:
    """The value at the path as a type; as `text` anything without white space at its ends, as `said` a text alone."""
    if isinstance(p, Reading):
        return p.value(path, kind)
    if kind == "said":
        return F.when(F.schema_of_variant(F.try_variant_get(p, path, "variant")) == "STRING", value(p, path, "text"))
    return stripped(F.try_variant_get(p, path, "string")) if kind == "text" else F.try_variant_get(p, path, kind)


def shared(part: Part) -> Part:
    """The part as a column of its own, for what is much work and named many times. It is worked out for postings that don't count, too."""
    return lambda p: p.part(part) if isinstance(p, Reading) else part(p)


def at(*paths: str) -> Part:
    """The first value at the paths that isn't blank, as text."""
    return lambda p: F.coalesce(*[value(p, x, "text") for x in paths])


def said(path: str) -> Part:
    """The value at the path if it is a text."""
    return lambda p: value(p, path, "said")


def first(*parts: Part) -> Part:
    return lambda p: F.coalesce(*[x(p) for x in parts])


def joined(*parts: Part, mark: str = ", ") -> Part:
    """The parts that have a value, in order; none if none has."""
    return lambda p: F.nullif(F.concat_ws(mark, *[x(p) for x in parts]), F.lit(""))


def items(p: Column | Reading, path: str) -> Column:
    return F.coalesce(value(p, path, "array<variant>"), F.array().cast("array<variant>"))


def each(path: str, part: Part, mark: str = "; ") -> Part:
    """The part of every item of an array."""
    return lambda p: F.nullif(F.array_join(F.transform(items(p, path), part), mark), F.lit(""))


def template(text: str) -> Part:
    """`{$.path}` is a value of the posting, `{name}` a column of the payload's row; none if one is missing."""
    pieces = re.split(r"\{([^}]+)\}", text)
    return lambda p: F.concat(*[F.lit(x) if i % 2 == 0 else at(x)(p) if x.startswith("$") else stripped(F.col(x).cast("string")) for i, x in enumerate(pieces) if x])


def mapped(part: Part, table: Mapping[str, str], other: Part | None = None) -> Part:
    """The table's word for the lower-cased value; else `other`, or the value with hyphens for blanks."""

    def known(p: Column) -> Column:
        value = F.lower(part(p))
        word = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)
        return F.coalesce(word, other(p) if other else F.replace(value, F.lit(" "), F.lit("-")))

    return known


def hyphened(part: Part) -> Part:
    return lambda p: F.replace(F.lower(part(p)), F.lit("_"), F.lit("-"))


def day(*paths: str) -> Part:
    return lambda p: parse_date(at(*paths)(p))


def written(part: Part) -> Part:
    return lambda p: written_date(part(p))


def truth(*paths: str) -> Part:
    """Whether the value is there and neither false, zero nor blank."""
    return lambda p: F.coalesce(~F.lower(at(*paths)(p)).isin("false", "0", "null"), F.lit(False))


def equals(path: str, value: str) -> Part:
    return lambda p: F.coalesce(at(path)(p) == value, F.lit(False))


def nothing() -> Column:
    return F.lit(None).cast("string")


def none(p: Column) -> Column:
    return nothing()


def no_day(p: Column) -> Column:
    return F.lit(None).cast("date")


def no(p: Column) -> Column:
    return F.lit(False)


def always(p: Column) -> Column:
    return F.lit(True)


# ---- what some boards need of their own ----


def _sections(p: Column) -> Column:
    """Texts with headings, each heading over its content."""
    found = F.flatten(F.transform(items(p, "$.lists"), lambda s: F.array_compact(F.array(F.concat(F.lit("<h3>"), at("$.text")(s), F.lit("</h3>")), at("$.content")(s)))))
    return F.nullif(F.array_join(found, "\n"), F.lit(""))


def _money(p: Column) -> Column:
    """`EUR 50,000–60,000` of an object with min, max and currency; an end that is zero counts as missing."""
    ends = F.array_compact(F.array(*[F.nullif(F.format_number(value(p, f"$.salary.{k}", "double").cast("long"), 0), F.lit("0")) for k in ("min", "max")]))
    return F.when(F.size(ends) > 0, F.concat_ws(" ", at("$.salary.currency")(p), F.array_join(ends, "–")))


def _with_pay(part: Part) -> Part:
    return lambda p: F.nullif(F.concat_ws("\n\n", part(p), F.concat(F.lit("Salary: "), _money(p))), F.lit(""))


def _class_terms(prefix: str, last_first: bool = False) -> Part:
    """Class names with the prefix as words: `location-new-york` is New York."""

    def terms(p: Column) -> Column:
        own = F.filter(F.coalesce(value(p, "$.class_list", "array<string>"), F.array().cast("array<string>")), lambda c: c.startswith(prefix) & (F.length(c) > len(prefix)))
        words = F.transform(own, lambda c: F.initcap(F.replace(F.substring(c, len(prefix) + 1, 1000), F.lit("-"), F.lit(" "))))
        return F.nullif(F.array_join(F.reverse(words) if last_first else words, ", "), F.lit(""))

    return terms


_WEB_LINKS = shared(lambda p: F.filter(F.transform(items(p, "$.links"), at("$.href")), lambda x: x.rlike("(?i)^https?:")))


def _link_of_job(p: Column) -> Column:
    """The first web link that names a job, else the first web link, else the page that was read."""
    links = _WEB_LINKS(p)
    return F.coalesce(F.get(F.filter(links, lambda x: x.rlike("(?i)[?&]jobId=")), F.lit(0)), F.get(links, F.lit(0)), stripped(F.col("careers_url")))


def _columns_at(p: Column) -> Column:
    """Values of the columns whose numbers are listed; a value may be a JSON list."""
    # parsing any other text raises an exception inside
    listed = lambda v: F.btrim(v, F.lit(" \t\r\n\ufeff")).startswith("[")
    columns, numbers = value(p, "$.column", "array<string>"), F.coalesce(value(p, "$.locationsColumns", "array<int>"), F.array().cast("array<int>"))
    values = F.transform(F.filter(numbers, lambda i: (i >= 0) & (i < F.size(columns))), lambda i: F.get(columns, i))
    names = F.flatten(F.transform(values, lambda v: F.coalesce(F.when(listed(v), F.try_variant_get(F.try_parse_json(v), "$", "array<string>")), F.array(v))))
    found = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(found, "; "), F.lit(""))


def _last_column(p: Column) -> Column:
    columns = value(p, "$.column", "array<string>")
    return F.when(F.size(columns) > 2, F.element_at(columns, -1))


def _in_language(name: str) -> Part:
    """A field that has a text for each language: the posting's language is English where its title has one, else Swedish."""
    return lambda p: F.when(at("$.title.en")(p).isNotNull(), at(f"$.{name}.en")(p)).otherwise(at(f"$.{name}.sv")(p))


@shared
def _cities(p: Column) -> Column:
    """The cities of a posting: names between ; , | or /, and a state's two capitals stay with the city before them."""
    listed = F.coalesce(*[F.coalesce(F.array_join(value(p, f"$.cities.{x}", "array<string>"), ","), at(f"$.cities.{x}")(p)) for x in ("en", "sv")])
    other = F.coalesce(*[F.coalesce(F.array_join(value(p, f"$.cities.{x}", "array<string>"), ","), at(f"$.cities.{x}")(p)) for x in ("sv", "en")])
    text = F.when(at("$.title.en")(p).isNotNull(), listed).otherwise(other)
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,|/]"), lambda x: F.trim(x)), lambda x: x != "")
    state = lambda x: x.rlike("^[A-Z]{2}$")
    return F.aggregate(names, F.array().cast("array<string>"), lambda all_, x: F.when(state(x) & (F.size(all_) > 0), F.concat(F.slice(all_, 1, F.size(all_) - 1), F.array(F.concat_ws(", ", F.element_at(all_, F.greatest(F.size(all_), F.lit(1))), x)))).otherwise(F.concat(all_, F.array(x))))


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "åäö", "aao"), "[^a-z0-9]+", "-")


_CITY_SLUG = shared(lambda p: F.trim(_slug(F.get(_cities(p), F.lit(0))), F.lit("-")))
_COUNTRY_SLUG = shared(lambda p: F.trim(_slug(_in_language("country")(p)), F.lit("-")))
_TITLE_SLUG = shared(lambda p: F.regexp_replace(_slug(F.replace(_in_language("title")(p), F.lit("+"), F.lit(""))), "-$", ""))


@shared
def _place_slug(p: Column) -> Column:
    city, country = _CITY_SLUG(p), _COUNTRY_SLUG(p)
    place = F.when(country == "united-states", city).otherwise(F.nullif(F.concat_ws("-", city, country), F.lit("")))
    return F.when(place.startswith("san-diego-ca-"), "san-diego-ca").otherwise(place)


def _made_url(p: Column) -> Column:
    """The page of a posting whose payload has no URL: title, place, language and day."""
    stamp = F.date_format(F.to_date(F.substring(at("$.publicationDate")(p), 1, 10)), "yyyyMMdd")
    title, place = _TITLE_SLUG(p), _place_slug(p)
    english = at("$.title.en")(p).isNotNull()
    return F.concat(F.lit("https://www.sigma.se/"), F.when(english, "position/").otherwise("sv/position/"), F.concat_ws("-", title, F.coalesce(place, F.lit("None")), F.when(english, "en").otherwise("sv"), stamp), F.when(stamp.isNotNull(), ""))


def _paragraph(part: Part, lead: str = "") -> Part:
    return lambda p: F.concat(F.lit(f"<p>{lead}"), escaped(part(p)), F.lit("</p>"))


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _bullets(path: str, heading: str) -> Part:
    """Lines as a list under a heading."""

    def section(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(at(path)(p), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"<h3>{heading}</h3>\n<ul>\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "\n"), F.lit("\n</ul>")))

    return section


def _footers(p: Column) -> Column:
    """The first footer on pay, in any language."""
    entries = F.flatten(F.flatten(F.transform(items(p, "$.postingFooters"), lambda f: F.map_values(F.coalesce(F.try_variant_get(f, "$.localizations", "map<string, array<variant>>"), F.create_map().cast("map<string, array<variant>>"))))))
    pay = F.filter(entries, lambda e: (at("$.name")(e) == "Pay & Benefits") & at("$.content")(e).isNotNull())
    return F.concat(F.lit("<h3>Pay &amp; Benefits</h3>\n"), at("$.content")(F.get(pay, F.lit(0))))


def hydrated(html: Column) -> Column:
    """JSON that a page hands to a script as a string."""
    raw = F.regexp_extract(html, r'(?s)__staticRouterHydrationData\s*=\s*JSON\.parse\("(.*?)"\);', 1)
    return F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def page_data(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)window\.pageData\s*=\s*(\{.*?\});\s*(?:</script>|\n)", 1)


# ---- boards of JSON ----


@dataclass(frozen=True)
class Board:
    """rows: paths of the array of postings, the first that is there; inner: the posting inside an item of it.

    tenant: columns that the payload's row must have. json: how the JSON is got from the payload. keep: which postings
    count. merged: postings of one external id are one, with all its places.
    """

    rows: tuple[str, ...]
    title: Part
    url: Part
    external_id: Part
    location: Part = none
    description: Part = none
    job_type: Part = none
    posted: Part = no_day
    remote: Part = no
    keep: Part = always
    inner: str = "$"
    tenant: tuple[str, ...] = ()
    json: Callable[[Column], Column] = field(default=lambda text: text)
    merged: bool = False


#: fixed values: words of boards for kinds of employment
_TYPES = {"fulltime": "full-time", "full_time": "full-time", "full-time": "full-time", "full time": "full-time", "regular full time": "full-time", "parttime": "part-time", "part_time": "part-time", "part-time": "part-time", "part time": "part-time", "contract": "contract", "contractor": "contract", "fixed term": "contract", "temporary": "contract", "internship": "internship"}
_APPLE_TYPES = {"standard": "full-time", "part time": "part-time", "part-time": "part-time", "intern": "internship", "internship": "internship", "contractor": "contract", "contract": "contract", "temporary": "temporary"}

_CITY_COUNTRY = lambda path, *country: joined(at(f"{path}.city"), at(*[f"{path}.{c}" for c in country]))
_SEARCHED = joined(_paragraph(at("$.team.teamName"), "Team: "), _paragraph(at("$.jobSummary")), mark="\n")

#: fixed values: where each board's public payload keeps its fields, and its public URLs
BOARDS: dict[str, Board] = {
    "adp": Board(
        ("$.jobRequisitions",), at("$.requisitionTitle"),
        template("https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={cid}&ccId=19000101_000001&type=MP&lang=en_US&jobId={$.itemID}"),
        at("$.itemID"), at("$.requisitionLocations[0].address.cityName"), posted=day("$.postDate"), tenant=("cid",),
    ),
    "amazon": Board(
        ("$.jobs", "$"), at("$.title"), template("https://www.amazon.jobs{$.job_path}"), at("$.id_icims"), at("$.normalized_location"),
        joined(said("$.description"), said("$.basic_qualifications"), said("$.preferred_qualifications"), mark="\n"), hyphened(at("$.job_schedule_type")), written(at("$.posted_date")),
    ),
    "apple": Board(
        ("$.loaderData.search.searchResults",), at("$.postingTitle"),
        lambda p: F.concat(F.lit("https://jobs.apple.com/en-us/details/"), at("$.id", "$.reqId")(p), F.lit("/"), F.coalesce(at("$.transformedPostingTitle")(p), F.lit(""))),
        at("$.id", "$.reqId"), first(at("$.locations[0].name"), _CITY_COUNTRY("$.locations[0]", "countryName")), _SEARCHED,
        posted=lambda p: F.coalesce(written(at("$.postingDate"))(p), day("$.postingDate")(p)), json=hydrated,
    ),
    "ashby": Board(
        ("$.jobs", "$.jobBoard"), at("$.title"), at("$.jobUrl", "$.url"), at("$.id"), first(said("$.location"), at("$.location.name", "$.location.city")),
        at("$.descriptionHtml", "$.descriptionPlain"), mapped(at("$.employmentType"), _TYPES), day("$.publishedAt"),
    ),
    "awsm": Board(
        ("$",), shared(lambda p: stripped(unescape(at("$.title.rendered")(p)))), at("$.link"), at("$.id", "$.link"), _class_terms("location-", last_first=True),
        at("$.content.rendered"), _class_terms("employment-type-"), day("$.date_gmt", "$.date"),
    ),
    "bamboohr": Board(
        ("$.result",), at("$.jobOpeningName"), template("https://{slug}.bamboohr.com/careers/{$.id}"), at("$.id"),
        first(said("$.location"), _CITY_COUNTRY("$.location", "addressCountry", "country"), said("$.atsLocation"), _CITY_COUNTRY("$.atsLocation", "addressCountry", "country")),
        none, mapped(at("$.employmentStatusLabel", "$.employmentType"), _TYPES), day("$.datePosted"), truth("$.isRemote"), tenant=("slug",),
    ),
    "eightfold": Board(
        ("$.data.positions",), at("$.name"), template("https://{host}{$.positionUrl}"), at("$.id"), each("$.locations", at("$")), posted=day("$.postedTs"),
        remote=equals("$.workLocationOption", "remote"), tenant=("host",),
    ),
    "gibson": Board(
        ("$.data.jobRequisitions",), at("$.postingInstructions[0].nameCode.codeValue"), _link_of_job, at("$.itemID"),
        joined(*[said(f"$.requisitionLocations[0].address.{x}") for x in ("cityName", "countrySubdivisionLevel1.codeValue", "countryCode")]),
        said("$.postingInstructions[0].nameCode.longName"), posted=day("$.postingInstructions[0].postDate"), keep=equals("$.requisitionStatusCode.codeValue", "ON"), tenant=("careers_url",),
    ),
    "greenhouse": Board(
        ("$.jobs",), at("$.title"), at("$.absolute_url"), at("$.id"), at("$.location.name"), lambda p: decoded_content(at("$.content")(p)), posted=day("$.updated_at"),
    ),
    "jibe": Board(
        ("$.jobs",), said("$.title"), template("https://{host}/jobs/{$.slug}"), at("$.slug"), joined(said("$.city"), said("$.state"), said("$.country")), at("$.description"),
        said("$.employment_type"), day("$.posted_date", "$.create_date", "$.update_date"), inner="$.data", tenant=("host",),
    ),
    "jobsyn": Board(
        ("$.jobs",), said("$.title"),
        first(template("https://{host}/{$.customAttributes.city_display_slug.stringValues[0]}/{$.customAttributes.title_slug.stringValues[0]}/{$.requisitionId}/job/"), template("https://{host}/{$.requisitionId}/job/")),
        first(at("$.customAttributes.reqid.stringValues[0]"), at("$.requisitionId")), first(at("$.customAttributes.city_display.stringValues[0]"), at("$.addresses[0]")), at("$.description"),
        posted=day("$.postingPublishTime", "$.postingCreateTime"), keep=lambda p: said("$.requisitionId")(p).isNotNull(), inner="$.job", tenant=("host",), merged=True,
    ),
    "lever": Board(
        ("$",), at("$.text"), at("$.hostedUrl", "$.applyUrl"), at("$.id"), at("$.categories.location"), joined(at("$.description", "$.descriptionPlain"), _sections, at("$.additional"), mark="\n"),
        hyphened(at("$.categories.commitment")), day("$.createdAt"),
    ),
    "paylocity": Board(
        ("$.Jobs",), at("$.JobTitle"), template("https://recruiting.paylocity.com/Recruiting/Jobs/Details/{$.JobId}"), at("$.JobId"),
        first(joined(at("$.JobLocation.City"), at("$.JobLocation.State")), at("$.LocationName")), at("$.Description"), posted=day("$.PublishedDate"), remote=truth("$.IsRemote"),
        keep=lambda p: ~truth("$.IsInternal")(p), json=page_data,
    ),
    "pinpoint": Board(
        ("$.data",), at("$.title"), at("$.url"), at("$.id"), first(said("$.location"), at("$.location.name", "$.location.city")),
        joined(at("$.description"), at("$.key_responsibilities"), at("$.skills_knowledge_expertise"), mark="\n\n"), mapped(at("$.employment_type"), _TYPES), day("$.deadline_at"), equals("$.workplace_type", "remote"),
    ),
    "recruitee": Board(
        ("$.offers",), at("$.title"), at("$.careers_url", "$.url"), at("$.id", "$.slug"), joined(at("$.city"), at("$.country")), _with_pay(at("$.description", "$.requirements")),
        mapped(at("$.employment_type_code"), _TYPES), day("$.published_at"), truth("$.remote"),
    ),
    "sigma": Board(
        ("$",), _in_language("title"), _made_url, at("$.id"), lambda p: F.nullif(F.array_join(_cities(p), ", "), F.lit("")),
        joined(*[_in_language(x) for x in ("description", "qualifications", "offer", "experience")], mark="\n"), posted=lambda p: F.to_date(F.substring(at("$.publicationDate")(p), 1, 10)),
        keep=lambda p: F.startswith(F.lower(F.coalesce(said("$.company")(p), F.lit(""))), F.lower(F.coalesce(F.col("company_prefix"), F.lit("")))), tenant=("company_prefix",),
    ),
    "smartrecruiters": Board(
        ("$.content",), at("$.name"), first(template("https://jobs.smartrecruiters.com/{$.company.identifier}/{$.id}"), template("https://jobs.smartrecruiters.com/{slug}/{$.id}"), at("$.ref")), at("$.id"),
        first(said("$.location"), _CITY_COUNTRY("$.location", "country")), none, mapped(at("$.typeOfEmployment.label"), {k: v for k, v in _TYPES.items() if "-" in k or " " not in k}, lambda p: F.lower(at("$.typeOfEmployment.label")(p))),
        day("$.releasedDate"), tenant=("slug",),
    ),
    "taleo": Board(
        ("$.requisitionList",), at("$.column[0]"), template("https://{host}/careersection/{section}/jobdetail.ftl?job={$.contestNo}&lang=en"), at("$.contestNo"), _columns_at,
        posted=written(_last_column), tenant=("host", "section"),
    ),
    "ultipro": Board(
        ("$.opportunities",), at("$.Title"), template("https://{host}/{tenant}/JobBoard/{board_id}/OpportunityDetail?opportunityId={$.Id}"), at("$.Id"),
        each("$.Locations", first(joined(at("$.Address.City"), at("$.Address.State.Code"), at("$.Address.Country.Code")), at("$.LocalizedDescription"))), said("$.BriefDescription"),
        lambda p: F.when(value(p, "$.FullTime", "boolean"), "full-time"), day("$.PostedDate"), tenant=("host", "tenant", "board_id"),
    ),
    "workday": Board(
        ("$.jobPostings",), at("$.title"), template("{base}/{site}{$.externalPath}"), at("$.externalPath"), at("$.locationsText"), none, mapped(at("$.timeType"), _TYPES),
        lambda p: relative_date(at("$.postedOn")(p), F.col("as_of")), tenant=("base", "site", "as_of"),
    ),
}


def postings(payloads: DataFrame, board: str, keys: list[str], payload: str = "payload") -> DataFrame:
    """Posting rows (keys, place, FIELDS) of the payloads of one board.

    The frame has the board's tenant columns. Payloads that don't parse, and postings without title or URL, give no row.
    """
    b = BOARDS[board]
    if missing := [x for x in b.tenant if x not in payloads.columns]:
        raise ValueError(f"{board} needs the columns {', '.join(missing)}")
    own = [x for x in b.tenant if x not in keys]
    p = Reading(b.inner)
    parts = (b.title, b.url, b.external_id, b.location, b.description, b.job_type, b.posted, b.remote)
    keep, found = b.keep(p), [part(p).alias(name) for name, part in zip(FIELDS, parts, strict=True)]
    parsed = payloads.select(*keys, *own, F.try_parse_json(b.json(F.col(payload))).alias("__v"))
    listed = F.coalesce(*[F.try_variant_get("__v", x, f"array<{p.type()}>") for x in b.rows])
    rows = p.columns(parsed.select(*keys, *own, F.posexplode(listed).alias("place", "__item")), "__item", [*keys, *own, "place"])
    # an item that is no object has no title
    out = rows.where(keep).select(*keys, "place", *found).where("title is not null and url is not null")
    return merged(out, keys) if b.merged else out


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each external id: the first, with the places of all, each once and in order."""
    names = [x for x in ("place", *FIELDS) if x not in ("external_id", "location")]
    by = rows.groupBy(*keys, "external_id").agg(F.min_by(F.struct(*names), "place").alias("r"), F.array_sort(F.collect_list(F.when(F.col("location").isNotNull(), F.struct("place", "location")))).alias("l"))
    return by.select(*keys, "r.place", *[F.nullif(F.array_join(F.array_distinct(F.col("l.location")), "; "), F.lit("")).alias(x) if x == "location" else F.col(x) if x == "external_id" else F.col(f"r.{x}") for x in FIELDS])


# ---- details ----


def _ld(html: Column) -> Column:
    """The first posting among a page's linked data."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1), lambda x: F.try_parse_json(x))
    whole = F.filter(F.flatten(F.transform(F.array_compact(blocks), lambda v: F.coalesce(F.try_variant_get(v, "$.@graph", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v)))), lambda v: F.contains(at("$.@type")(v), F.lit("JobPosting")))
    return F.get(whole, F.lit(0))


_LD_PLACE = joined(*[at(f"$.jobLocation.address.{x}", f"$.jobLocation[0].address.{x}") for x in ("addressLocality", "addressRegion", "addressCountry")])


def _attribute(html: Column, prop: str, name: str = "content") -> Column:
    """An attribute of the first element with the itemprop, whichever comes first."""
    tag = F.regexp_extract(html, rf"(?is)<[a-z]+[^>]*\bitemprop=[\"']{prop}[\"'][^>]*>", 0)
    return stripped(unescape(F.regexp_extract(tag, rf"(?is)\b{name}=[\"']([^\"']*)[\"']", 1)))


def _element(html: Column, prop: str) -> Column:
    """What stands in the first element with the itemprop, up to the end of an element of its kind."""
    return stripped(F.regexp_extract(html, rf"(?is)<([a-z]+)[^>]*\bitemprop=[\"']{prop}[\"'][^>]*>(.*?)</\1\s*>", 2))


def _rich_parts(html: Column) -> Column:
    """Rich texts in a page's encoded history, without statements on equal opportunity."""
    history = unescape(F.regexp_extract(html, r'id="initialHistory"\s+value="([^"]*)"', 1))
    parts = F.transform(F.split(history, r"!\|!"), lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    rich = F.filter(parts, lambda x: x.startswith("!*!") & (F.length(x) >= 200))
    bodies = F.transform(rich, lambda x: F.replace(F.substring(x, 4, 10_000_000), F.lit("\\:"), F.lit(":")))
    legal = lambda x: F.substring(F.lower(x), 1, 400).rlike("affirmative action|employment equity|equal opportunity")
    return F.nullif(F.array_join(F.filter(bodies, lambda x: ~legal(x)), "\n"), F.lit(""))


@F.pandas_udf(StringType())
def _longest_chunk(html: pd.Series) -> pd.Series:
    """The longest text that a page streams to its scripts, freed of Markdown's marks; none under 200 characters."""
    push, head = re.compile(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)'), re.compile(rb"(?:^|\n)[0-9a-f]{1,8}:T([0-9a-f]{1,8}),")

    def longest(page: str | None) -> str | None:
        stream = b""
        for m in push.finditer(page or ""):
            try:
                stream += json.loads(m[1]).encode("utf-8", "replace")
            except ValueError:
                continue
        texts = [stream[m.end() : m.end() + int(m[1], 16)].decode("utf-8", "ignore") for m in head.finditer(stream)]
        best = max(texts, key=len, default="")
        return re.sub(r"\*{1,3}|_{2,3}", "", re.sub(r"(?m)^#{1,6}\s{0,3}", "", best)).strip() if len(best) >= 200 else None

    return html.map(longest)


def _markdown_body(text: Column) -> Column:
    """What follows the heading of the description, without front matter and the board's own line."""
    after = F.regexp_extract(text, r"(?s)## Description(.*)$", 1)
    body = F.regexp_replace(F.regexp_replace(after, r"(?ms)^---\n.*$", ""), r"Powered by \[.*", "")
    rest = F.regexp_extract(text, r"(?s)\n(## .*)$", 1)
    return stripped(F.when(text.contains("## Description"), body).when(rest != "", rest).otherwise(text))


_JSON = lambda **parts: lambda text: {k: x(F.try_parse_json(text)) for k, x in parts.items()}

#: fixed values: where the detail of a posting keeps what its listing leaves out
DETAILS: dict[str, Callable[[Column], dict[str, Column]]] = {
    "adp": _JSON(description=lambda p: stripped(page_text(at("$.requisitionDescription")(p)))),
    "apple": lambda html: {
        k: x(F.try_variant_get(F.try_parse_json(hydrated(html)), "$.loaderData.jobDetails.jobsData", "variant"))
        for k, x in {
            "job_type": mapped(at("$.employmentType"), _APPLE_TYPES, none),
            "description": joined(
                _paragraph(at("$.teamName"), "Team: "), _paragraph(at("$.jobSummary")), _paragraph(at("$.description")), _bullets("$.responsibilities", "Responsibilities"),
                _bullets("$.minimumQualifications", "Minimum Qualifications"), _bullets("$.preferredQualifications", "Preferred Qualifications"), _footers, mark="\n",
            ),
        }.items()
    },
    "bamboohr": _JSON(description=at("$.result.jobOpening.description")),
    "eightfold": _JSON(description=said("$.data.jobDescription")),
    "haileyhr": lambda html: {"description": _longest_chunk(html)},
    "icims": lambda html: {"description": at("$.description")(_ld(html)), "location": _LD_PLACE(_ld(html)), "posted_date": day("$.datePosted")(_ld(html))},
    "paylocity": lambda html: {"description": at("$.description")(_ld(html))},
    "smartrecruiters": _JSON(description=joined(*[at(f"$.jobAd.sections.{x}.text") for x in ("jobDescription", "companyDescription", "qualifications")], mark="\n\n")),
    "successfactors": lambda html: {
        "description": _element(html, "description"),
        "posted_date": F.coalesce(*[f(F.coalesce(_attribute(html, "datePosted"), page_text(_element(html, "datePosted")))) for f in (parse_date, written_date)]),
        "location": F.coalesce(_attribute(html, "streetAddress"), stripped(page_text(_element(html, "jobLocation")))),
    },
    "taleo": lambda html: {"description": _rich_parts(html)},
    "workable": lambda text: {"description": _markdown_body(text)},
    "workday": _JSON(description=at("$.jobPostingInfo.jobDescription")),
}


def with_details(rows: DataFrame, details: DataFrame, board: str, keys: list[str], payload: str = "payload") -> DataFrame:
    """The rows with what the details (keys, payload) of their postings say; what a detail doesn't say stays."""
    found = DETAILS[board](F.col(payload))
    one = details.select(*keys, *[v.alias(f"__{k}") for k, v in found.items()]).groupBy(*keys).agg(*[F.max(f"__{k}").alias(f"__{k}") for k in found])
    return rows.join(one, keys, "left").withColumns({k: F.coalesce(f"__{k}", k) for k in found}).drop(*[f"__{k}" for k in found])


# ---- boards whose listings are pages ----


@dataclass(frozen=True)
class PageBoard:
    """link: which anchors are postings, matched against the whole element; external_id: group 1, taken from the link.

    title: what to take of an anchor, tried in order. place: the first chip, and whether a chip says remote.
    dropped: parameters that a link loses.
    """

    link: str
    external_id: str
    title: tuple[str, ...] = (r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", r"(?is)<a\b[^>]*>(.*)</a>")
    place: str = r"(?!)"
    dropped: tuple[str, ...] = ()


_UUID = "[0-9a-fA-F-]{36}"
#: fixed values: how the listing pages of these boards show a posting
PAGE_BOARDS: dict[str, PageBoard] = {
    "haileyhr": PageBoard(rf"(?i)href=[\"'][^\"']*/job/{_UUID}/{_UUID}/{_UUID}", rf"(?i)/job/{_UUID}/{_UUID}/({_UUID})", place=r"(?is)<div\b[^>]*\bflex-wrap\b[^>]*>\s*((?:<div\b[^>]*>[^<]*</div>\s*)+)"),
    "icims": PageBoard(r"(?i)href=[\"'][^\"']*/jobs/\d{1,15}/[^/\"']{1,200}/job/?(?:[?#][^\"']*)?[\"']", r"(?i)/jobs/(\d{1,15})/", dropped=("in_iframe", "hub")),
    "successfactors": PageBoard(r"(?i)class=[\"'][^\"']*\bjobTitle-link\b", r"/(\d{1,20})/?(?:[?#]|$)", title=(r"(?is)<a\b[^>]*>(.*)</a>",)),
}
_HIDDEN = r"(?is)<(\w+)\b[^>]*class=[\"'][^\"']*(?:sr-only|screen-reader|visually-hidden)[^\"']*[\"'][^>]*>.*?</\1>"


def page_postings(pages: DataFrame, board: str, keys: list[str], html: str = "html", base: str = "base") -> DataFrame:
    """Posting rows of listing pages of one board; of several links to a posting the first counts."""
    b = PAGE_BOARDS[board]
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(*keys, F.col(base).alias("__base"), F.posexplode(F.filter(anchors, lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0).rlike(b.link))).alias("place", "__a"))
    seen = F.regexp_replace("__a", _HIDDEN, " ")
    title = F.coalesce(*[stripped(F.regexp_replace(page_text(F.nullif(F.regexp_extract(seen, x, 1), F.lit(""))), r"\s+", " ")) for x in b.title])
    link = stripped(unescape(F.regexp_extract("__a", r"(?is)\bhref=[\"']([^\"']*)[\"']", 1)))
    for name in b.dropped:
        link = F.regexp_replace(F.regexp_replace(link, rf"(?i)([?&]){name}=[^&#]*&?", "$1"), r"[?&]$", "")
    chips = F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("__a", b.place, 1), F.lit("(?is)<div[^>]*>([^<]*)</div>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    url = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat("__base", link)).otherwise(F.concat_ws("/", "__base", link))
    found = rows.select(
        *keys, "place", title.alias("title"), url.alias("url"), F.nullif(F.regexp_extract(link, b.external_id, 1), F.lit("")).alias("external_id"), F.get(chips, F.lit(0)).alias("location"),
        nothing().alias("description"), nothing().alias("job_type"), F.lit(None).cast("date").alias("posted_date"), F.exists(chips, lambda x: x.rlike(r"(?i)\bremote\b")).alias("remote_hint"),
    ).where("title is not null and url is not null")
    once = found.groupBy(*keys, F.coalesce("external_id", "url").alias("__id")).agg(F.min_by(F.struct("place", *FIELDS), "place").alias("r"))
    return once.select(*keys, "r.*")


def markdown_postings(pages: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """Posting rows of a Markdown table: title, department, place, type, pay, day and a link named View; `slug` names the board."""
    line = pages.select(*keys, "slug", F.posexplode(F.split(markdown, "\n")).alias("place", "__line")).where(F.col("__line").rlike(r"^\|[^|]+(?:\|[^|]*){5}\|\s*\[View\]\([^)]+\)"))
    cells = F.transform(F.split("__line", r"\|"), lambda x: F.nullif(F.trim(x), F.lit("—")))
    rows = line.select(*keys, "slug", "place", cells.alias("c"), F.trim(F.regexp_extract("__line", r"\[View\]\(([^)]+)\)", 1)).alias("__url"))
    cell = lambda i: stripped(F.get("c", F.lit(i)))
    job = F.nullif(F.regexp_extract("__url", r"(?i)/(?:jobs/view|j)/([A-F0-9]+)", 1), F.lit(""))
    pay = lambda i: F.replace(F.regexp_extract(cell(5), r"^([A-Z]{3})\s*([\d,]+)\s*[–-]\s*([\d,]+)", i), F.lit(","), F.lit(""))
    kind = F.lower(cell(4))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() if "-" in kv[0] or kv[0].isalpha() for x in kv]), kind), F.replace(kind, F.lit(" "), F.lit("-")))
    return rows.select(
        *keys, "place", cell(1).alias("title"), F.coalesce(F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), job), F.col("__url")).alias("url"), job.alias("external_id"), cell(3).alias("location"),
        nothing().alias("description"), known.alias("job_type"), parse_date(cell(6)).alias("posted_date"), F.lit(False).alias("remote_hint"),
        pay(2).try_cast("int").alias("salary_min"), pay(3).try_cast("int").alias("salary_max"), F.nullif(pay(1), F.lit("")).alias("salary_currency"),
    ).where("title is not null")
