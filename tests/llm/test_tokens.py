from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listwright.llm.common import work_dir
from listwright.llm.token_shards import PerfectHash, PieceEncoder, Shard, fingerprint, lookup, op1_token_shards, read_documents, write_shards
from listwright.llm.trie_bpe import TrieBpe, encode_documents, op7_trie_bpe

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["a  b", "a   b \n c", "  x", "x  ", "\n\nfoo\n bar", "a\x1c!\x1c b", "x  <|endoftext|> y<|endoftext|>Z<|startoftext|>", "don't  they'll", "é è  z", "a\t\tb \t c", "", " ", " \n", "A!\n!B \n  C", "日本語 テキスト。\n次", "ΟΔΟΣ İi", "x \x85 y", "éa ́b", "<|endoftext| >", "WORD!!,. x.;y"]
byte_library, word_library = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
word_library.no_truncation()
word_library.no_padding()


@lru_cache(1)
def one_of_each():
    return PieceEncoder(BYTES), TrieBpe(WORDS)


@pytest.fixture(scope="module")
def pieces():
    return one_of_each()[0]


@pytest.fixture(scope="module")
def trie():
    return one_of_each()[1]


def as_bytes(ids, kind):
    return np.array(ids, kind).tobytes()


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_like_library(pieces):
    assert [x.tolist() for x in pieces.encode(ODD)] == ids_of(byte_library, ODD)


LETTERS = st.one_of(st.sampled_from(list("ab .,!'stmdrevl \n\t\r\x0b\x1c\x85é日0\u00a0\u2003ΣſÅ\u0301👍")), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=30), min_size=1, max_size=4))
def test_pieces_on_any_text(texts):
    assert [x.tolist() for x in one_of_each()[0].encode(texts)] == ids_of(byte_library, texts)


def test_trie_like_library(trie):
    for text, (ids, decoded) in zip(ODD, trie.encode(ODD), strict=True):
        wanted = word_library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted, text
        assert decoded == word_library.decode(wanted, skip_special_tokens=False).encode(), text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=40), min_size=1, max_size=4))
def test_trie_on_any_text(texts):
    assert [x.tolist() for x, _ in one_of_each()[1].encode(texts)] == ids_of(word_library, texts)


def test_every_character(pieces, trie):
    """Each code point beside letters, blanks, digits and marks: classes, case and normal forms are the library's."""
    signs = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0x1F000, 0x1FB00)] if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b {c}1 {c}!\n{c}{c} '{c}s" for c in signs[i : i + 50]) for i in range(0, len(signs), 50)]
    for text, got, wanted in zip(texts, pieces.encode(texts), ids_of(byte_library, texts), strict=True):
        assert got.tolist() == wanted, ascii(text)
    for text, (got, _), wanted in zip(texts, trie.encode(texts), ids_of(word_library, texts), strict=True):
        assert got.tolist() == wanted, ascii(text)


def test_marks_in_a_row(trie):
    """Marks are put in order by their classes, of which the library may know fewer or others than Python."""
    rng = random.Random(2)
    marks = [chr(i) for i in range(0x110000) if unicodedata.combining(chr(i))]
    texts = ["".join(rng.choice((rng.choice(marks), rng.choice(marks), rng.choice("ae한üΣς x"))) for _ in range(rng.randrange(2, 9))) for _ in range(8000)]
    texts += [f"d{a}{b}" for a in ("\u0487", "\u0334", "\u0345") for b in marks]
    for text, (got, said), wanted in zip(texts, trie.encode(texts), ids_of(word_library, texts), strict=True):
        assert got.tolist() == wanted, ascii(text)
        assert said.decode() == word_library.decode(wanted, skip_special_tokens=False), ascii(text)


def test_long_texts_are_cut_between_pieces(pieces, trie, monkeypatch):
    monkeypatch.setattr("listwright.llm.spans.BLOCK", 40)
    texts = ["", "no  cut \n" * 30 + "it's  the end", "x" * 200 + " y", " \n" * 60]
    assert [x.tolist() for x in pieces.encode(texts)] == ids_of(byte_library, texts)
    assert [x.tolist() for x, _ in trie.encode(texts)] == ids_of(word_library, texts)


def test_trie_words_by_definition(trie):
    words = ["antidisestablishmentarianism", "antidote", "ant", "a", "thththth", "zzzzzzzzz", "internationalization"]
    for w, ids in zip(words, trie.encode_words(words), strict=True):
        assert [trie.token[i] for i in ids] == trie.merge([*w[:-1], w[-1] + "</w>"])


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    assert sorted(PerfectHash.of(keys.view(np.uint64)).slots(keys.view(np.uint64))) == list(range(len(keys)))
    shard = Shard.from_bytes(Shard.of(2, keys, np.arange(len(keys) + 3)).to_bytes())
    assert (shard.find(keys) == np.arange(len(keys)) + 2).all()
    others = np.setdiff1d(keys + 1, keys)
    assert (shard.find(others) >= 0).sum() <= 2  # a fingerprint of 32 bits
    assert len(np.unique(fingerprint(keys.view(np.uint64)))) > 0.999 * len(keys)
    assert (Shard.of(0, keys[:0], np.zeros(1, np.int64)).find(keys) == -1).all()


def test_op1(spark, folder):
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(op1_token_shards(spark, folder).collect())
    start = 0
    for row, (doc, at, n, crc) in zip(rows, got, strict=True):
        ids = byte_library.encode(row["text"], add_special_tokens=False).ids + [0]
        assert (row["doc_id"], start, len(ids), zlib.crc32(as_bytes(ids, "<u4"))) == (doc, at, n, crc)
        start += len(ids)


def test_shards_of_odd_documents(spark, odd_docs):
    path = work_dir(spark, "odd")
    write_shards(odd_docs, path, BYTES)
    got = read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 7, 8]
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    found = {r["doc_id"]: r["ids"] for r in lookup(spark.createDataFrame([(1,), (3,), (99,), (None,), (1,)], "doc_id long"), path).collect()}
    assert found == {1: byte_library.encode("one two three four five six").ids + [0], 3: [0]}
    empty = work_dir(spark, "empty")
    write_shards(odd_docs.limit(0), empty, BYTES)
    assert read_documents(spark, empty).count() == 0


def test_op7(spark, folder):
    got = {r["doc_id"]: r for r in op7_trie_bpe(spark, folder).collect()}
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = word_library.encode(text, add_special_tokens=False).ids
        decoded = word_library.decode(ids, skip_special_tokens=False)
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), hashlib.sha256(as_bytes(ids, "<u4")).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_of_odd_documents(spark, odd_docs):
    rows = encode_documents(odd_docs, WORDS, with_ids=True).collect()
    assert len(rows) == 10 and sum(r["n_tokens"] == 0 for r in rows) == 4
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert encode_documents(odd_docs.limit(0), WORDS).count() == 0
