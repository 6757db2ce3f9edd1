"""What requests and settings ask for, as values: lists of ids, sets of words, filters of a board page, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import parse_qsl, urlsplit

from .board import JobFilter
from .health import GRADES

MOST_IDS, DEFAULT_PAGE_SIZE = 200, 20
#: fixed values: what a board page may be asked for, which of them are sets, and the names that filters know them by
ALLOWED = ("q", "category", "seniority", "job_type", "salary_min", "salary_max", "company_id", "company", "location", "country", "remote", "sort", "per_page")
SETS, ALIASES = ("category", "seniority", "job_type"), {"q": "search"}
SECONDS, PRIORITY_TIMES = 90.0, 2.0


def ids(text: str | None, most: int = MOST_IDS) -> list[int] | None:
    """Numbers between commas, of the first `most` parts; None if nothing was asked."""
    return None if text is None else [int(x) for x in map(str.strip, text.split(",")[:most]) if x.isdigit()]


def words(text: str | None) -> list[str] | None:
    """Parts between commas that aren't blank; None if there is none."""
    return [x.strip() for x in (text or "").split(",") if x.strip()] or None


def grades(text: str, default: Sequence[str]) -> list[str]:
    found = words(text) or []
    if odd := [x for x in found if x not in GRADES]:
        raise ValueError(f"unknown grades: {', '.join(odd)}; there are {', '.join(GRADES)}")
    return found or list(default)


def board_params(url: str) -> dict[str, str]:
    """The known parameters of a board page's URL. Sets may come in one value or in several; a salary of 0 or less asks for nothing."""
    given: dict[str, list[str]] = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        given.setdefault(k, []).append(v)
    out = {}
    for key in ALLOWED:
        values = given.get(key, [])
        if key in SETS:
            values = list(dict.fromkeys(x for v in values for x in words(v) or ()))
            value = ",".join(values)
        else:
            value = values[0] if values else ""
        if value and not (key == "salary_min" and _number(value, 1.0) <= 0):
            out[ALIASES.get(key, key)] = value
    page = int(_number((given.get("page") or ["1"])[0], 1))
    return {"per_page": str(DEFAULT_PAGE_SIZE), **out, "page": str(max(1, page))}


def board_filter(params: Mapping[str, str]) -> JobFilter:
    """The filter that the parameters ask for; numbers that are none are left out."""
    number = lambda k: int(params[k]) if params.get(k, "").lstrip("-").isdigit() else None
    truth = {"true": True, "false": False}.get(params.get("remote", "").lower())
    return JobFilter(
        category=tuple(words(params.get("category")) or ()), seniority=words(params.get("seniority")), job_type=words(params.get("job_type")), salary_min=number("salary_min"), salary_max=number("salary_max"),
        company_id=number("company_id"), company=params.get("company"), location=params.get("location"), country=params.get("country"), remote=truth, search=params.get("search"),
    )


def _number(text: str, default: float) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def setting(environment: Mapping[str, str], name: str, default: float) -> float:
    """A number of the default's kind from the environment; the default where it is missing or none."""
    try:
        return type(default)(environment.get(name, default))
    except ValueError:
        return default


def company_seconds(priority: bool, seconds: float = SECONDS, times: float = PRIORITY_TIMES) -> float:
    """How long one company may take."""
    return seconds * times if priority else seconds
