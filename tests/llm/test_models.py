from __future__ import annotations

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from listwright.llm import language_id as L
from listwright.llm import quality as Q
from listwright.llm.common import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def predicted(spark):
    return L.op4_language_id(spark, "/root/testdata/sf0.01").toPandas()


def test_language_accuracy(spark, predicted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = predicted.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(both) == len(docs) and 0.25 < len(held) / len(both) < 0.42
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all() and both.rejected.mean() < 0.005
    # what is rejected of long texts is one word over and over, not prose
    for text in both[both.rejected].text:
        words = text.split()
        assert len(words) < 25 or len(set(words)) < 0.2 * len(words)


def test_language_by_brute_force(spark, predicted):
    """The nearest centroid, computed text by text with plain dictionaries from the model's own centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.select("doc_id", "text", "lang").where(~L.held_out(docs["doc_id"])))
    found = {r.doc_id: r for r in predicted.itertuples()}
    for row in docs.where("doc_id % 25 = 0").collect():
        counts = collections.Counter()
        data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in row["text"].lower().encode())
        for n in (2, 3):
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if b"  " not in gram:
                    counts[((int.from_bytes(gram, "big") + (n << 24)) % 2**32 * 0x9E3779B1 % 2**32) >> 19] += 1
        weights = {k: math.log1p(v) * float(model.idf[k]) for k, v in counts.items()}
        norm = math.sqrt(sum(v * v for v in weights.values())) or 1
        cosines = [sum(v * float(c[k]) for k, v in weights.items()) / norm for c in model.centers]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert abs(cosines[best] - found[row["doc_id"]].score) < 1e-3
        assert found[row["doc_id"]].lang_pred == model.languages[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4


def test_held_out_is_the_stated_rule(predicted):
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(predicted.doc_id, predicted.held_out, strict=True))


def test_language_of_odd_documents(spark, odd_docs):
    model = L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == 10
    for r in rows:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or (r["score"] == 0 and r["rejected"]))
    junk = spark.createDataFrame([("xqzj kkwv zzqx jjvk qqqw",), ("привет как дела",)], "text string")
    assert all(r["rejected"] for r in L.predict(junk, model).collect())
    nothing = L.fit(odd_docs.limit(0))
    assert {r["lang_pred"] for r in L.predict(odd_docs, nothing).collect()} == {"und"}
    assert L.stage_language_id(spark, odd_docs.limit(0), "").columns == odd_docs.columns


def test_base_counts(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", None, "a b c a b c", "x\nx\n \n \nx", "a a a a", "#*$%&|<> [é] 日本", "w " * 3000]
    got = Q.base_counts(pa.array(texts))
    for i, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        wanted = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted


def grams_of(text):
    data = b" " + re.sub(rb"[ \t\n\x0b\x0c\r]+", b" ", re.sub(rb"[0-9]", b"0", text.lower().encode())).lstrip(b" ")
    data = data if data.endswith(b" ") and len(data) > 1 else data + b" "
    return [data[i : i + 4] for i in range(len(data) - 3)]


def test_gram_counts(spark):
    texts = ["Hello  world 42", "a", "", "  lead and trail ", "naïve\n\nline", None]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    got = {int(r["gram"]).to_bytes(4, "big"): r["n"] for r in Q.count_grams(docs).collect()}
    assert got == collections.Counter(itertools.chain(*(grams_of(t) for t in texts if t)))


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_hash_array(n):
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 2 * n, dtype=np.uint64) << np.uint64(1))
    array = Q.HashArray(keys[::2][::-1], np.arange(len(keys[::2]))[::-1])
    assert (array.values[array.find(keys[::2])] == np.arange(len(keys[::2]))).all()
    assert (array.find(keys[1::2]) == -1).all() and (array.find(np.array([0, 2**64 - 1], np.uint64)) == -1).all()


def test_kneser_ney_by_definition(spark):
    """Probabilities of the arrays against the recursive definition."""
    texts = ["the cat sat on the mat and the dog sat on the cat", "a cat and a dog on a mat", "the thing then there"] * 2
    counts = Q.count_grams(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))
    model = Q.Lookup(Q.train(counts, work_dir(spark, "kn"), range_grams=100))
    assert model.model.bits >= 1
    tables = {4: collections.Counter(itertools.chain(*map(grams_of, texts)))}
    for order in (3, 2, 1):
        tables[order] = collections.Counter(g[1:] for g in tables[order + 1])

    def discounts(table):
        ones = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.5
        return [0.0] + [min(max(i - (i + 1) * y * ones[i] / ones[i - 1], 0.05), i * 0.95) if ones[i - 1] else 0.5 * i for i in (1, 2, 3)]

    taken = {o: discounts(t) for o, t in tables.items()}

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / 256
        same = {g: n for g, n in tables[order].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        free = sum(taken[order][min(n, 3)] for n in same.values()) / total
        n = same.get(gram, 0)
        return max(n - taken[order][min(n, 3)], 0) / total + free * p(gram[1:])

    english = np.array([Q.language_hash("en")])
    for gram in (b"the ", b" cat", b"cat ", b"xyz ", b"themes"[:4], b"zzzz", b"at s"):
        assert math.isclose(float(model.log2(np.array([int.from_bytes(gram, "big")], np.uint64), english)[0]), math.log2(p(gram)), abs_tol=1e-4), gram
    seen = sum(p(b"the" + bytes([b])) for b in range(256))
    assert math.isclose(seen, 1, abs_tol=1e-6)


def test_quality(spark, folder, odd_docs):
    rows = Q.op9_quality(spark, folder).toPandas()
    failed = (rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words)
    assert (rows.base_failed == failed).all() and not (rows.kept & rows.base_failed).any()
    assert rows[~rows.base_failed].kept.mean() > 0.97
    judged = Q.judge(Q.measure(odd_docs, Q.train(Q.count_grams(odd_docs), work_dir(spark, "odd")))).collect()
    assert len(judged) == 10 and all(r["kept"] is not None for r in judged)
    nothing = Q.train(Q.count_grams(odd_docs.limit(0)), work_dir(spark, "none"))
    assert Q.judge(Q.measure(odd_docs, nothing)).count() == 10 and Q.measure(odd_docs.limit(0), nothing).count() == 0


def test_noise_is_out_of_its_band(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 7))) for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(60)]
    noise = "".join(rng.choice(list("zqxjkvbwyp#~{}^"), 800)).replace("z", " ").replace("q", " ")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, noise])], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(Q.measure(docs, Q.train(Q.count_grams(docs), work_dir(spark, "noise")))).collect()}
    assert all(kept[i] for i in range(60)) and not kept[60]


def test_ranges_change_no_result(spark, folder, odd_docs, monkeypatch):
    """A model in many ranges, read for a little text at a time, gives the very same numbers."""
    order = ["doc_id", "lang", "n_words", "log2_perplexity"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").unionByName(odd_docs.select("doc_id", "lang", "text"))
    counts = Q.count_grams(docs)
    one, many = Q.train(counts, work_dir(spark, "one")), Q.train(counts, work_dir(spark, "many"), range_grams=700)
    assert one.bits == 0 and many.bits >= 4
    monkeypatch.setattr(Q, "GROUP_BYTES", 20_000)
    got = [sorted(map(str, Q.measure(docs, m).select(order).collect())) for m in (one, many)]
    assert got[0] == got[1]


def test_bands_by_hand(spark, folder):
    """Who is kept, from the measures alone."""
    rows = Q.op9_quality(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    for _, own in rows.groupby("lang"):
        good = np.sort(own[~own.base_failed].bits_a_byte.to_numpy())
        low, high = (good[max(0, math.ceil(q * len(good)) - 1)] for q in (0.25, 0.75))
        slack = Q.SPREAD * max(high - low, 0.01)
        inside = own.bits_a_byte.between(low - slack, high + slack)
        near = (own.bits_a_byte - (low - slack)).abs().lt(2e-3) | (own.bits_a_byte - (high + slack)).abs().lt(2e-3)
        assert ((own.kept == (~own.base_failed & inside)) | near).all()
