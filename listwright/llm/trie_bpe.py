"""BPE encoding and decoding over a trie of distinct words.

In a BPE encoding every prefix of a word is encoded by the same tokens up to a last one, and that last token is the
only one that fits: it ends the prefix and is what merging leaves after the last token of the prefix before it. So a
node of a trie needs one token only, its last. The distinct words of a batch go into a trie that is walked depth-first
(in sorted order; the path's tokens are the stack), so the states of shared prefixes are computed once; a word's ids
follow from its last node back to the root. A node's state, its longest ending that begins a token, names the tokens
that may be its last.

The tokenizer file is read as data: BPE with the word-end mark `</w>`, after Unicode NFC, lower case and the usual
split into contractions, letters, single digits and other marks. Decoding follows the file too: tokens joined by a
blank. What a word encodes to is kept; so many words that memory stays bounded.

Defined cases: a null text counts as empty: no ids, an empty decoded text. Special tokens written in a text become
their ids, as the library does by default. Repeated rows give equal results; very long texts are handled whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_chunks, string_bytes, table
from .spans import SpanCache, encode_texts, same_normal, well_known

END = "</w>"
#: words and pairs of tokens that a Python worker keeps; bytes of text at a time
CACHE_WORDS, CACHE_PAIRS, CHUNK = 600_000, 400_000, 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def _known_codes(path: str) -> np.ndarray:
    """Code points that the library's normalizer and Python's tables treat alike; kept by a worker."""
    from tokenizers import Tokenizer

    return same_normal(Tokenizer.from_file(path).normalizer.normalize_str, TrieBpe._normal)


class TrieBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for what Python's Unicode tables don't know
        self.known_codes = _known_codes(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {b: c for b, c in byte_letters().items()}
        self.made_by = {a + b: (a, b) for a, b in reversed(merges)}
        self.spines: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        #: the beginnings of all tokens without the mark of an end; a node's state is its longest ending among them
        self.beginnings = {t[:i] for w in self.vocab for t in (w.removesuffix(END),) for i in range(len(t) + 1)}
        self.state_of: dict[str, int] = {}
        self.text_of: list[str] = []
        self.moves: list[dict[str, int]] = []
        #: by state, the tokens that may end there, the longest first, inside a word and at its end: (length, id)
        self.inside: list[list[tuple[int, int]]] = []
        self.at_end: list[list[tuple[int, int]]] = []
        self.proper: dict[str, bool] = {}
        self._state("")
        #: whether two tokens of a word stay apart, by their ids
        self.apart: dict[int, bool] = {}
        self.size = [len(self.token[i].removesuffix(END)) if i in self.token else 0 for i in range(max(self.token) + 1)]
        self.cache = SpanCache(self._new, [np.dtype("<u4"), np.dtype("u1")], CACHE_WORDS)

    def _state(self, text: str) -> int:
        """The number of a state; the tokens that end there are listed when it is first met."""
        known = self.state_of.get(text)
        if known is None:
            known = self.state_of[text] = len(self.text_of)
            self.text_of.append(text)
            self.moves.append({})
            endings = [text[i:] for i in range(len(text))]
            self.inside.append([(len(t), self.vocab[t]) for t in endings if self._is_proper(t)])
            self.at_end.append([(len(t), self.vocab[t + END]) for t in endings if self._is_proper(t + END)])
        return known

    def _is_proper(self, token: str) -> bool:
        """Whether the token is one that its own text encodes to."""
        known = self.proper.get(token)
        if known is None:
            known = self.proper[token] = token in self.vocab and self.merge(self.symbols(token)) == [token]
        return known

    def _move(self, state: int, letter: str) -> int:
        text = self.text_of[state] + letter
        while text not in self.beginnings:
            text = text[1:]
        new = self.moves[state][letter] = self._state(text)
        return new

    def _stay_apart(self, pair: int) -> bool:
        if len(self.apart) > CACHE_PAIRS:
            self.apart.clear()
        fits = self.apart[pair] = self.fits(self.token[pair >> 20], self.token[pair & 0xFFFFF])
        return fits

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return [*token[:-1], token[-1] + END]
        return [*token]

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: the earliest merge first, everywhere, until none applies."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == [*best]:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The tokens at one edge of a token while it is merged: (token, rank that made it, rank that takes it up)."""
        known = self.spines.get((token, side))
        if known is None:
            known, taken, t = [], 1 << 60, token
            while (parts := self.made_by.get(t)) is not None:
                made = self.rank[parts]
                known.append((t, made, taken))
                t, taken = parts[side], made
            known.append((t, -1, taken))
            self.spines[token, side] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when their text is encoded together.

        They don't if some merge across their border comes while both its parts are at the border: after they are made
        and before they are taken up. At equal rank the merge further left comes first.
        """
        rank, starts = self.rank, self.spine(right, 0)
        for x, x_made, x_taken in self.spine(left, 1):
            for y, y_made, y_taken in starts:
                q = rank.get((x, y), -1)
                if q >= 0 and x_made < q < x_taken and y_made < q <= y_taken:
                    return False
        return True

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of the tokens of each word (in byte letters), by a depth-first walk of the words' trie."""
        out: list[list[int]] = [[]] * len(words)
        # the path of the word before: states and last tokens of its beginnings
        states, last, before = [0], [-1], ""
        moves, inside, at_end, apart, size = self.moves, self.inside, self.at_end, self.apart, self.size
        for place in sorted(range(len(words)), key=words.__getitem__):
            word = words[place]
            n = len(word)
            most, shared = min(len(last) - 1, n - 1), 0
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for i in range(shared + 1, n):
                letter = word[i - 1]
                at = moves[state].get(letter)
                state = self._move(state, letter) if at is None else at
                states.append(state)
                for length, token in inside[state]:  # exactly one fits
                    if length == i:
                        break
                    pair = last[i - length] << 20 | token
                    fits = apart.get(pair)
                    if self._stay_apart(pair) if fits is None else fits:
                        break
                last.append(token)
            at = moves[state].get(word[-1])
            for length, token in at_end[self._move(state, word[-1]) if at is None else at]:
                if length == n:
                    break
                pair = last[n - length] << 20 | token
                fits = apart.get(pair)
                if self._stay_apart(pair) if fits is None else fits:
                    break
            found, i = [token], n - length
            while i:
                token = last[i]
                found.append(token)
                i -= size[token]
            found.reverse()
            out[place] = found
            before = word
        return out

    def _new(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the words, and their tokens each followed by a blank, in UTF-8."""
        letters, token = self.letters, self.token
        ids = self.encode_words([w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in words])
        decoded = [(" ".join([token[i] for i in x]) + " ").encode() for x in ids]
        return [
            (np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))),
            (np.frombuffer(b"".join(decoded), np.uint8), np.fromiter(map(len, decoded), np.int64, len(ids))),
        ]

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decoded text in UTF-8) of each text."""
        special = self.special_re.search if self.special_re is not None else lambda _: None
        odd = {i for i, t in enumerate(texts) if special(t) or not well_known(t, self.known_codes)}
        plain = ["" if i in odd else self._normal(t) for i, t in enumerate(texts)]
        ids, decoded = encode_texts(self.cache, plain, blank_in_front=False, single_digits=True)
        return [self._by_parts(texts[i]) if i in odd else (x, y.tobytes()[:-1]) for i, (x, y) in enumerate(zip(ids, decoded, strict=True))]

    def _by_parts(self, text: str) -> tuple[np.ndarray, bytes]:
        """A text with special tokens, or with characters that Python's tables don't know: the library finds the latter's words."""
        found = []
        for part in filter(None, self.special_re.split(text) if self.special_re is not None else [text]):
            if part in self.special:
                found.append((np.array([self.special[part]], "<u4"), part.encode()))
            elif well_known(part, self.known_codes):
                found += self.encode([part])
            else:
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                ids = list(chain.from_iterable(self.encode_words(words)))
                found.append((np.array(ids, "<u4"), " ".join([self.token[i] for i in ids]).encode()))
        return np.concatenate([x for x, _ in found]), b" ".join(y for x, y in found if len(x))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document its key, token count and digests of its ids and of the decoded text; with_ids: the ids as well (`ids` array)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TrieBpe(tokenizer)  # of this task alone: workers go on to other stages, which need the memory
        for batch in batches:
            texts = batch.column(1)
            _, offsets = string_bytes(texts)
            for a, b in row_chunks(offsets, CHUNK):
                coded = bpe.encode(texts.slice(a, b - a).to_pylist())
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x, _ in coded], pa.int64())]
                columns += [pa.array([hashlib.sha256(x[i]).hexdigest() for x in coded], pa.string()) for i in (0, 1)]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x, _ in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return rows.mapInArrow(task, f"doc_id long, {SCHEMA}" + ", ids array<int>" * with_ids)


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
