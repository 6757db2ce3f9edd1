from __future__ import annotations

import random
import re

import pytest

from listwright.llm.common import work_dir
from listwright.llm.graph import connected_components
from listwright.llm.jaccard_join import similar_components, stage_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, k, percent):
    """(doc_id -> (set size, component)) by comparing all pairs."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.setdefault(doc, set()).add(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (max(map(len, sets[d])), find(d)) for d in ids}


def documents(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 12, 60, 150)))]
        rows.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3, 8))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
        if i % 3 == 0:
            rows.append(passage + " " + " ".join(rng.choice(vocabulary) for _ in range(5)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(30):  # neighbours link, ends don't
        chain = list(chain)
        chain[rng.randrange(100)] = f"c{i}"
        rows.append(" ".join(chain))
    rows += ["", None, "\t \n", "one", "One", "one two", "one two"]
    rng.shuffle(rows)
    return [(10 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_like_all_pairs(spark, seed, k, percent):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(docs, work_dir(spark, "j"), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_crowded_lists(spark):
    """Many near copies of one text at several distances: the links are those of all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = list(words)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(docs, work_dir(spark, "j"), 3, 80).collect()}
    assert got == brute(rows, 3, 80)


def test_odd_documents(spark, odd_docs):
    got = similar_components(odd_docs, work_dir(spark, "j")).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == 10 and by[5]["component_id"] == 4 and by[2]["n_shingles"] == 0 and by[3]["component_id"] == 3
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert similar_components(odd_docs.limit(0), work_dir(spark, "j")).count() == 0


def test_stage_keeps_one_of_each(spark, odd_docs):
    kept = stage_jaccard_join(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 7, 8, None, None]


def test_stage_keeps_different_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "other words under the same id", "x"), (1, "a b c d e f g h", "x"), (None, "a b c d e f g h", "y"), (None, "", "z"), (None, "", "z"), (2, "A b c d e f g h", "x")]
    kept = stage_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "a b c d e f g h"), ("1", "other words under the same id"), ("None", ""), ("None", "")]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200) if i % 20 != 19] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000, 5001 + i) for i in range(100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), work_dir(spark, "g")).collect()))
    assert got == {x: find(x) for a, b in links for x in (a, b) if a != b or x in got}
