"""PII: format-preserving Feistel pseudonyms.

Private values are found by their form and validated (check digits, calendar, octets, lengths); each is then mapped by
a keyed permutation of all values of its form, so equal values stay equal across documents and different ones differ.
The permutation is a Feistel network on a pair of residues whose product covers the number of values, walked until it
falls among them. Marks, letter case, lengths and check digits stay valid: a card number stays a card number.

Kinds: email, card (Luhn), iban (mod 97, in one piece or in groups), ssn, ip of either version, phone, date (in numbers or
with a month's name in one of four languages), and secrets (access keys and values after words such as `password=`, in any
case). Numbers that fail their validation are left alone, as are dates that no calendar has. What is permuted is the value
itself: an IBAN, a number or an address is linked with its other spellings, and a date with its other forms. Dates from
1900 to 2099 are permuted among themselves, and so are those before and after.

Defined cases: a null text stays null, an empty one empty, both with n_private 0. Repeated rows are mapped alike. All
input columns are kept, the text replaced; a column named n_private is replaced. Texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_chunks, string_bytes, table

ROUNDS = 10
CHUNK = 4 << 20
#: dates from the first to the last day of an age are permuted among themselves; the ages of four-digit years
AGES = [tuple(datetime.date(*x).toordinal() for x in age) for age in (((1000, 1, 1), (1899, 12, 31)), ((1900, 1, 1), (2099, 12, 31)), ((2100, 1, 1), (9999, 12, 31)))]
#: fixed values: names of months, January to December
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "en, short": "jan feb mar apr may jun jul aug sep oct nov dec",
}
MONTH_NAMES = {k: v.split() for k, v in MONTHS.items()}
_MONTH = "|".join(sorted({m for names in MONTH_NAMES.values() for m in names}, key=lambda m: (-len(m), m)))

_EMAIL = r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_SECRET = r"(?P<access>(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z]))|(?:(?i:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]\s?[\"']?(?P<secret>[A-Za-z0-9+/_.-]{6,}))"
_PHONE = r"(?P<phone>(?<![\w])0\d(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w])\+\d{8,15}(?!\w))"
_NUMBERS = "|".join(
    (
        r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))",
        rf"(?P<named>(?i:(?<![\w-])\d{{1,2}}(?:st|nd|rd|th|er|\.)?(?: de)? (?:{_MONTH})\.?,?(?: de)? \d{{4}}(?![\w-])|\b(?:{_MONTH})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?![\w-])))",
        r"(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))",
        r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
        r"(?P<ymd>(?<![\w-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\w-]))",
        r"(?P<dmy>(?<![\w-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\w-]))",
        r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
        _PHONE,
    )
)


_IP6 = r"(?P<ip6>(?<![\w:.])(?=[^\s]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]))"


class Permutation:
    """A keyed permutation of 0..n-1 for each (kind, n)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, kind: str, n: int, x: int) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        width = (max(a, b).bit_length() + 7) // 8
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS):
                seen = right if i % 2 == 0 else left
                mark = b"%s|%d|%d|" % (kind.encode(), n, i) + seen.to_bytes(width, "little")
                noise = int.from_bytes(b"".join(hashlib.blake2b(mark + bytes([j]), key=self.key, digest_size=64).digest() for j in range(width // 48 + 1)), "little")
                if i % 2 == 0:
                    left = (left + noise) % a
                else:
                    right = (right + noise) % b
            x = left * b + right
            if x < n:
                return x

    def text(self, kind: str, value: str, fixed: str = "") -> str:
        """Every digit to a digit and every ASCII letter to a letter of its case, all together one permutation; other characters stay, as those in `fixed` do."""
        radix = [0 if c in fixed else 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0 for c in value]
        n, x = 1, 0
        for c, r in zip(value, radix, strict=True):
            if r:
                n, x = n * r, x * r + (ord(c) - 48 if r == 10 else ord(c.lower()) - 97)
        x = self(kind, n, x)
        out = []
        for c, r in zip(reversed(value), reversed(radix), strict=True):
            if r:
                x, d = divmod(x, r)
                c = chr(48 + d) if r == 10 else chr((97 if c.islower() else 65) + d)
            out.append(c)
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def filled(form: str, digits: str) -> str:
    """The form with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def email(p: Permutation, v: str) -> str | None:
    """A permutation of the local parts of that form, for each domain; case does not count."""
    local, _, domain = v.rpartition("@")
    return p.text("email@" + domain.lower(), local.lower()) + "@" + domain if _is_host(domain) else None


def _is_host(domain: str) -> bool:
    return not domain.split(".")[-1].isdigit()


def card(p: Permutation, v: str) -> str | None:
    digits = "".join(c for c in v if c.isdigit())
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + p.text(f"card{digits[0]}", digits[1:-1])
    return filled(v, body + str(luhn(body)))


def iban(p: Permutation, v: str) -> str | None:
    """The same for every spelling of a number; its groups stay where they are."""

    def rest(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    tight = v.replace(" ", "")
    if not 15 <= len(tight) <= 34 or rest(tight[4:] + tight[:4]) != 1:
        return None
    body = p.text("iban" + tight[:2], tight[4:])
    new = iter(f"{tight[:2]}{98 - rest(body + tight[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in v)


def ip6(p: Permutation, v: str) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(v))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(p("ip6", 1 << 128, x)))


def ip(p: Permutation, v: str) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255:
        return None
    x = p("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn(p: Permutation, v: str) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(v.replace("-", ""))
    if not valid(x):
        return None
    x = p("ssn", 10**9, x)
    while not valid(x):
        x = p("ssn", 10**9, x)
    return filled(v, f"{x:09d}")


def phone(p: Permutation, v: str) -> str | None:
    digits = "".join(c for c in v if c.isdigit())
    if not 8 <= len(digits) <= 15 or not (v[0] == "+" or "(" in v or len(digits) >= 10):
        return None
    country = re.match(r"\+\d{1,3}(?=[ .(-])", v)
    at = country.end() if country else 0
    # numbers written differently are linked, since only their digits count
    return v[:at] + filled(v[at:], p.text("phone" + v[:at], "".join(c for c in v[at:] if c.isdigit())))


def _other_day(p: Permutation, year: int, month: int, day: int) -> datetime.date | None:
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    for i, (first, last) in enumerate(AGES):
        if first <= x <= last:
            return datetime.date.fromordinal(first + p("date" if i == 1 else f"date{i}", last - first + 1, x - first))
    return None


def _date(p: Permutation, v: str, order: str) -> str | None:
    parts = re.split(r"[-/.]", v)
    numbers = dict(zip(order, map(int, parts), strict=True))
    if order == "dmy" and numbers["m"] > 12:
        order, numbers = "mdy", {"m": numbers["d"], "d": numbers["m"], "y": numbers["y"]}
    new = _other_day(p, numbers["y"], numbers["m"], numbers["d"])
    if new is None:
        return None
    width = 4 + 2 + 2 == sum(map(len, parts))
    values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if width else str(new.month), "d": f"{new.day:02d}" if width else str(new.day)}
    mark = next(c for c in v if not c.isdigit())
    return mark.join(values[k] for k in order)


_NAMED = re.compile(rf"(?i)(?P<day>\d{{1,2}})(?P<th>st|nd|rd|th|er)?(?=\D)|(?P<year>\d{{4}})|(?P<month>{_MONTH})")


def named_date(p: Permutation, v: str) -> str | None:
    """A date with a month's name: the new one has its name in the same language, length and case."""
    found = {m.lastgroup if m.lastgroup != "th" else "day": m for m in _NAMED.finditer(v)}
    if len(found) != 3:
        return None
    word = found["month"]["month"]
    language = next(k for k, names in MONTH_NAMES.items() if word.lower() in names)
    new = _other_day(p, int(found["year"]["year"]), MONTH_NAMES[language].index(word.lower()) + 1, int(found["day"]["day"]))
    if new is None:
        return None
    name = MONTH_NAMES[language][new.month - 1]
    name = name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name
    ending = found["day"]["th"] or ""
    if ending and ending.lower() != "er":
        ending = "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    said = {"day": f"{new.day}{ending}", "month": name, "year": f"{new.year:04d}"}
    out, at = [], 0
    for kind, m in sorted(found.items(), key=lambda x: x[1].start()):
        out += [v[at : m.start()], said[kind]]
        at = m.end()
    return "".join([*out, v[at:]])


KINDS: dict[str, Callable[[Permutation, str], str | None]] = {
    "email": email, "iban": iban, "ip": ip, "ssn": ssn, "card": card, "phone": phone,
    "ip6": ip6, "named": named_date, "ymd": lambda p, v: _date(p, v, "ymd"), "dmy": lambda p, v: _date(p, v, "dmy"),
    "access": lambda p, v: v[:4] + p.text("access", v[4:]), "secret": lambda p, v: p.text("secret", v),
}


HINT = re.compile(r"A[KS]IA[0-9A-Z]|(?i:password|passwd|pwd|token|secret|api[_-]?key)\s?[=:]")
DIGIT, HINT_6 = re.compile(r"\d"), re.compile(r"::|(?:[0-9A-Fa-f]{1,4}:){7}")


@lru_cache(8)
def _pattern(emails: bool, secrets: bool, addresses: bool) -> re.Pattern:
    """Numbers, and what else a text has signs of."""
    return re.compile("|".join([*[_EMAIL] * emails, *[_SECRET] * secrets, *[_IP6] * addresses, _NUMBERS]))


PHONE, LEAD = re.compile(_PHONE), re.compile(r"[^\d]*\w+")


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.permutation = Permutation(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def new(self, kind: str, value: str) -> str | None:
        at = kind, value
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = KINDS[kind](self.permutation, value)
        return self.known[at]

    def __call__(self, text: str) -> tuple[str, int]:
        """The text with its private values replaced, and their number."""
        emails, secrets, addresses = "@" in text, bool(HINT.search(text)), bool(HINT_6.search(text))
        if not (emails or secrets or addresses or DIGIT.search(text)):
            return text, 0
        pattern = _pattern(emails, secrets, addresses)
        out, at, n, start = [], 0, 0, 0
        while m := pattern.search(text, start):
            kind = next(k for k, v in m.groupdict().items() if v is not None and k in KINDS)
            (a, b), value = m.span(kind), m[kind]
            new = self.new(kind, value)
            if new is None and kind == "iban":  # groups that begin with an IBAN
                for end in [i for i in range(len(value) - 1, 14, -1) if value[i] == " "]:
                    if (new := self.new(kind, value[:end])) is not None:
                        b = a + end
                        break
            if new is None and kind == "card":  # groups of digits that begin with a card number, or with a phone number
                for end in [i for i in range(len(value) - 1, 12, -1) if value[i] in " -"]:
                    if sum(map(str.isdigit, value[:end])) > 12 and (new := self.new(kind, value[:end])) is not None:
                        b = a + end
                        break
                else:
                    if (call := PHONE.match(text, a)) and (new := self.new("phone", call["phone"])) is not None:
                        b = call.end()
            if new is None:  # what follows the first digits may still be private
                start = a + LEAD.match(text[a:b]).end()
                continue
            out += [text[at:a], new]
            at = start = b
            n += 1
        return "".join([*out, text[at:]]), n


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The documents with private values replaced, and n_private."""
    kept = [c for c in docs.columns if c != "n_private"]
    at = kept.index(text)
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept])
    schema = rows.withColumn("n_private", F.lit(0).cast("long")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key)
        for batch in batches:
            _, offsets = string_bytes(batch.column(at))
            for a, b in row_chunks(offsets, CHUNK):
                part = batch.slice(a, b - a)
                pairs = [(None, 0) if x is None else change(x) for x in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([x for x, _ in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in pairs], pa.int64())], [*kept, "n_private"])

    return rows.mapInArrow(task, schema)


#: for the registered query alone; real use passes a secret
DEMO_KEY = b"listwright-demo"


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
