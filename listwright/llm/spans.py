"""Pieces that tokenizers split texts into, as spans of code points, and a cache of what pieces encode to.

The split is vectorised: code points have a class each (white space, letter, number, other), runs of one class are
pieces, and the few exceptions (contractions, a blank in front of a word) move single borders. A piece is known by a
64-bit hash, so only pieces never met before become strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

from .common import _powers, mix

SPACE, LETTER, NUMBER, OTHER = range(4)
#: code points handled at a time; longer texts are cut in front of white space, where pieces always end
BLOCK = 1 << 18
_CUT = re.compile(r"(?<=[^\s])[ \n]")
_CODES = 0x110000
#: fixed values: the code points of white space
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WHITE = frozenset(WHITE)


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(_CODES)], np.uint8)
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def _assigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(i)) != "Cn" for i in range(_CODES)])


def well_known(text: str, known: np.ndarray | None = None) -> bool:
    """Whether all characters have a meaning in this Python's version of Unicode, which may be older than the library's.

    known: by code point, what counts as known, as of `same_normal`.
    """
    return text.isascii() or bool((_assigned() if known is None else known)[code_points(text)].all())


def same_normal(library: Callable[[str], str], own: Callable[[str], str]) -> np.ndarray:
    """Which assigned code points two normalizers treat alike, whichever Unicode version each has.

    Looked at are each one by itself, its full decomposition, and, for those with a combining class, their order with one
    mark of every class in front and behind: marks move past each other by their classes.
    """
    same = _assigned().copy()
    same[0xD800:0xE000] = False
    marks = [i for i in np.flatnonzero(same).tolist() if unicodedata.combining(chr(i))]
    # marks that have had their class since long are known to either
    one_of = {unicodedata.combining(chr(i)): chr(i) for i in reversed(marks) if unicodedata.ucd_3_2_0.combining(chr(i)) == unicodedata.combining(chr(i))}
    apart = ","  # a mark that neither moves nor joins; white space makes no pieces, whatever becomes of it
    cases = [(i, chr(i)) for i in np.flatnonzero(same).tolist() if chr(i) != apart and i not in _WHITE]
    cases += [(i, unicodedata.normalize("NFD", c)) for i, c in cases if unicodedata.decomposition(c)]
    cases += [(i, x) for i in marks for other in one_of.values() for x in (other + chr(i), chr(i) + other)]
    for a in range(0, len(cases), 100_000):
        some = cases[a : a + 100_000]
        text = apart.join([x for _, x in some])
        for (i, _), x, y in zip(some, library(text).split(apart), own(text).split(apart), strict=True):
            if x != y:
                same[i] = False
    return same


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, _CODES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pieces(codes: np.ndarray, offsets: np.ndarray, blank_in_front: bool, single_digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of the pieces of texts laid end to end; offsets: where each text begins, and the end.

    blank_in_front: a blank belongs to the word after it, and white space makes pieces; else white space makes none.
    """
    n = len(codes)
    kind = classes()[codes]
    fresh = np.zeros(n + 1, bool)  # where a text begins, or all end
    fresh[offsets] = True
    begins = np.ones(n + 1, bool)
    begins[1:n] = (kind[1:] != kind[:-1]) | fresh[1:n]
    if single_digits:
        begins[:n] |= kind == NUMBER
    # an apostrophe at the front of a piece and the letters after it
    mark = np.flatnonzero((codes == 39) & begins[:n] & begins[1:])
    mark = mark[~fresh[mark + 1]]
    if blank_in_front:
        mark = mark[fresh[mark] | (codes[np.maximum(mark - 1, 0)] != 32)]
    mark = mark[kind[mark + 1] == LETTER]
    one = codes[mark + 1]
    longer = np.minimum(mark + 2, n - 1)
    two = np.where((mark + 2 < n) & ~begins[np.minimum(mark + 2, n)], codes[longer], 0)
    e, ell, m, d, s, t, r, v = (ord(c) for c in "elmdstrv")
    size = np.where((one == s) | (one == t) | (one == m) | (one == d), 1, 0)
    size = np.where(((two == e) & ((one == r) | (one == v))) | ((one == ell) & (two == ell)), 2, size)
    mark, size = mark[size > 0], size[size > 0]
    begins[mark + 1] = False
    begins[mark + 1 + size] = True
    if blank_in_front:
        # the last of a run of white space in front of a word: a blank joins the word, another mark stands alone
        word = np.flatnonzero(begins[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
        begins[word - 1] = True
        begins[word[codes[word - 1] == 32]] = False
    starts = np.flatnonzero(begins[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    if not blank_in_front:
        full = kind[starts] != SPACE
        starts, ends = starts[full], ends[full]
    return starts, ends


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_values()[codes] * powers[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows that begin at `first`, end to end, and where each row ends."""
    ends = np.cumsum(sizes)
    at = np.repeat(first - ends + sizes, sizes)
    at += np.arange(len(at))
    return flat[at], ends


class Rows:
    """Rows of one kind of number, appended and gathered."""

    def __init__(self, dtype):
        self.flat, self.starts, self.n, self.rows = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0, 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.n : self.n + len(values)] = values
        self.starts[self.rows + 1 : self.rows + 1 + len(sizes)] = self.n + np.cumsum(sizes)
        self.n, self.rows = self.n + len(values), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[rows]
        return gather(self.flat, first, self.starts[rows + 1] - first)


class SpanCache:
    """What distinct pieces encode to, in one or more kinds of rows; emptied when it holds `limit` pieces."""

    def __init__(self, encode: Callable[[list[str]], Sequence[tuple[np.ndarray, np.ndarray]]], dtypes: Sequence, limit: int):
        """encode: (values, sizes) for each kind, of a list of pieces."""
        self.encode, self.dtypes, self.limit = encode, dtypes, limit
        self.clear()

    def clear(self) -> None:
        #: hashes of the pieces in order, and their rows
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = [Rows(t) for t in self.dtypes]

    def find(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each piece; new ones are encoded."""
        if len(self.hashes) > self.limit:
            self.clear()
        hashes, first, place = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, len(self.hashes) - 1)
        known = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        found = self.slots[near] if len(self.hashes) else np.zeros(len(hashes), np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            spans = first[new]
            strings = [text[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]
            found[new] = self.rows[0].rows + np.arange(len(new))
            for kind, (values, sizes) in zip(self.rows, self.encode(strings), strict=True):
                kind.extend(values, sizes)
            self.hashes, self.slots = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.slots, at[new], found[new])
        return found[place]


def blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Text numbers and texts, about BLOCK code points at a time; a long text comes in several parts, in order."""
    numbers: list[int] = []
    parts: list[str] = []
    total = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK and (m := _CUT.search(text, at + BLOCK)):
                end = m.start()
            numbers.append(i)
            parts.append(text[at:end] if at or end < len(text) else text)
            total += end - at
            at = end
            if total >= BLOCK:
                yield numbers, parts
                numbers, parts, total = [], [], 0
    if numbers:
        yield numbers, parts


def encode_texts(cache: SpanCache, texts: list[str], blank_in_front: bool, single_digits: bool) -> list[list[np.ndarray]]:
    """For each kind of rows of the cache, each text's values."""
    out: list[list[list[np.ndarray]]] = [[[] for _ in texts] for _ in cache.rows]
    for numbers, parts in blocks(texts):
        text = "".join(parts)
        codes = code_points(text)
        offsets = np.cumsum([0, *map(len, parts)])
        starts, ends = pieces(codes, offsets, blank_in_front, single_digits)
        slots = cache.find(text, codes, starts, ends)
        own = np.searchsorted(starts, offsets)  # the first piece of each part
        for kind, rows in zip(out, cache.rows, strict=True):
            values, stops = rows.take(slots)
            stops = np.concatenate([[0], stops])[own].tolist()
            for i, a, b in zip(numbers, stops, stops[1:], strict=False):
                kind[i].append(values[a:b])
    nothing = [np.zeros(0, t) for t in cache.dtypes]
    return [[x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in kind] for kind, none in zip(out, nothing, strict=True)]
