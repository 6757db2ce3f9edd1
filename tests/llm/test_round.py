"""Shard shuffle, filter audit and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import uuid
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from listwright.llm import shard_shuffle as ss
from listwright.llm.filter_audit import OP12_SQL, audit, masks_of, op12_filter_audit
from listwright.llm.periodic_runs import find_runs, loop_words, op13_periodic_runs, runs_of
from tests.oracle import rows as as_rows


# ---- sharding ----


def test_shards_are_the_shuffle_of_the_bucket_order(spark, folder, tmp_path):
    """The whole order again in Python: XXH64 of seed and key, buckets, sort, Fisher-Yates, stretches."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = ss.write_shards(docs, str(tmp_path / "a"), shards=5, seed=9, bucket_bytes=100_000).select("shard", "slot", "record.doc_id").collect()
    size = docs.selectExpr("sum(octet_length(text) + 1)").first()[0]
    buckets = max(ss.LEAST_BUCKETS, -(-size // 100_000))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    held = {}
    for r in docs.select("doc_id").collect():
        seed = xxhash.xxh64_intdigest((9).to_bytes(4, "little"), seed=42)
        h = signed(xxhash.xxh64_intdigest(r[0].to_bytes(8, "little"), seed=seed))
        held.setdefault(h % buckets, []).append((h, r[0]))
    order = []
    for b in sorted(held):
        rows = np.array([x[1] for x in sorted(held[b])])
        at = np.arange(len(rows))
        np.random.default_rng([9, b]).shuffle(at)
        order += rows[at].tolist()
    starts = ss.shard_starts(len(order), 5)
    wanted = {d: (s, i - starts[s]) for s in range(5) for i, d in enumerate(order) if starts[s] <= i < starts[s + 1]}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == wanted


def _law_holds(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_order_does_not_depend_on_partitions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = ss.write_shards(docs, str(tmp_path / "a")).select("shard", "slot", "record.doc_id").collect()
    b = ss.write_shards(docs.repartition(7), str(tmp_path / "b")).select("shard", "slot", "record.doc_id").collect()
    assert set(a) == set(b)
    _law_holds(a, ss.SHARDS)


def test_one_key_of_most_rows_is_spread(spark, tmp_path):
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    got = ss.write_shards(docs, str(tmp_path / "a")).selectExpr("shard", "slot", "record.doc_id").collect()
    _law_holds(got, ss.SHARDS)
    assert len(got) == 30_000 and sum(r["doc_id"] == 5 for r in got) == 20_000
    per = np.bincount([r["shard"] for r in got if r["doc_id"] == 5], minlength=ss.SHARDS)
    assert per.min() > 1000 and per.max() < 1500  # of 1,875 rows a shard two thirds are expected


def test_shards_of_odd_rows(spark, odd_docs, tmp_path):
    clashing = odd_docs.withColumns({"shard": F.lit("x"), "slot": F.lit(1), "bucket": F.lit(2), "hash": F.lit(3), "record": F.lit(4)})
    for i, d in enumerate((odd_docs, clashing)):
        got = ss.write_shards(d, str(tmp_path / f"{i}"), shards=3)
        assert as_rows(got.select("record.*").toPandas(), d.columns) == as_rows(d.toPandas(), d.columns)
        _law_holds(got.select("shard", "slot").collect(), 3)
    empty = ss.write_shards(odd_docs.limit(0), str(tmp_path / "empty"))
    assert empty.count() == 0 and empty.columns == ["record", "slot", "shard"]


def test_a_changed_input_fails(spark, tmp_path):
    """Keys that are other ones each time they are read would leave gaps; the counts tell."""
    changing = spark.range(100).mapInPandas(lambda frames: (f.assign(doc_id=[uuid.uuid4().int >> 70 for _ in range(len(f))], text="t")[["doc_id", "text"]] for f in frames), "doc_id long, text string")
    with pytest.raises(Exception, match="were counted"):
        ss.write_shards(changing, str(tmp_path / "a"))


# ---- filter audit ----


def _audit_by_hand(docs, labels):
    """One document and one order at a time."""
    texts, out = {}, {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            texts[t] = min(texts.get(t, d["doc_id"]), d["doc_id"])
    good = {x["doc_id"] for x in labels if x["quality"] == 1 and x["doc_id"] is not None}
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1 and x["doc_id"] is not None}
    for d in docs:
        t, part = d["text"] or "", d["source"] or ""
        for x in "\t\n\x0b\x0c\r":
            t = t.replace(x, " ")
        w = [x for x in t.split(" ") if x]
        t = d["text"] or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = d["doc_id"] is not None and d["doc_id"] > texts.get(t, d["doc_id"])
        rows = out.setdefault(part, {("".join(o), s): [0] * 7 for o in permutations("ABCDE") for s in range(1, 6)})
        for o in permutations("ABCDE"):
            gone = False
            for s, f in enumerate(o, 1):
                x = rows["".join(o), s]
                x[2] += gone and fails[f]
                x[3] += fails[f] and sum(fails.values()) == 1
                if fails[f] and not gone:
                    gone = True
                    x[1] += 1
                    x[4] += d["doc_id"] in good
                    x[5] += d["doc_id"] in toxic
                    for o2 in permutations("ABCDE"):
                        rows["".join(o2), o2.index(f) + 1][6] += 1
                x[0] += not gone
    return {(p, *k): v for p, rows in out.items() for k, v in rows.items()}


def test_audit_against_brute_force(spark, odd_docs):
    rng = random.Random(3)
    words = ["one", "Two", "THREE", "four|", "five", "$6"]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 5] + [f"w{rng.randrange(400)}"] * (i % 4)) for _ in range(rng.choice([3, 150, 199, 200, 260]))), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(0, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd_docs.select("doc_id", "text", "source"))
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(0, 110, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = audit(masks_of(docs.withColumn("part", F.lit("x")).withColumn("mask", F.lit(1))), labels).collect()
    wanted = _audit_by_hand([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert len(got) == len(wanted) == 600 * 6
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in got} == wanted


def test_audit_sends_parts_early(spark, odd_docs, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    whole = sorted(audit(masks_of(odd_docs), labels).collect(), key=str)
    monkeypatch.setattr("listwright.llm.filter_audit.PARTS_HELD", 0)
    assert sorted(audit(masks_of(odd_docs), labels).collect(), key=str) == whole
    assert audit(masks_of(odd_docs.limit(0)), labels).count() == 0


# ---- periodic runs ----


def _runs_by_hand(words, exponent=4, least=6):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, exponent * q) and j > i and not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def _texts():
    rng = random.Random(8)
    texts = ["", " ", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b " * 4, "x " + "a b a b c " * 6 + "y", "a " * 200, "a a b " * 50 + "a a c " * 40]
    for _ in range(150):
        alphabet = "ab" if rng.random() < 0.4 else "abcdefgh"
        words = [rng.choice(alphabet) for _ in range(rng.randrange(1, 30))]
        while len(words) < 200 and rng.random() < 0.8:
            a = rng.randrange(len(words))
            words += words[a : a + rng.randrange(1, 25)] * rng.randrange(1, 9)
            words += [rng.choice(alphabet) for _ in range(rng.randrange(3))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 20)])
def test_runs_against_brute_force(exponent, least):
    texts = _texts()
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = runs_of(raw, offsets, exponent, least)
    assert got == [_runs_by_hand(t.split(), exponent, least) for t in texts]
    assert sum(map(len, got)) > 100
    for parts in (2, 7):  # ranges of lags together find the same
        pieces = [runs_of(raw, offsets, exponent, least, k, parts) for k in range(parts)]
        assert [sorted(sum(x, []), key=lambda r: (r[0], r[2])) for x in zip(*pieces, strict=True)] == got


def test_long_texts_are_dealt_by_lags(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i % 90 if i % 17 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = find_runs(docs).collect()
    dealt = find_runs(docs, long_bytes=40).collect()
    assert sorted(map(str, whole)) == sorted(map(str, dealt))
    assert sum(len(r["runs"]) for r in whole) > 50


def test_query_against_brute_force(spark, folder, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", F.substring("text", 1, 9000).alias("text")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    wanted, found = [], 0
    for doc_id, text in docs.collect():
        w = (text or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _runs_by_hand(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
        wanted.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        found += bool(runs)
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert found >= 10


def test_runs_of_odd_rows(spark, odd_docs):
    got = find_runs(odd_docs.withColumn("runs", F.lit(1)).withColumn("place", F.lit(2))).collect()
    assert len(got) == 10 and all(r["collapsed"] is not None and r["runs"] is not None for r in got)
    assert find_runs(odd_docs.limit(0)).count() == 0
    assert odd_docs.limit(0).select("doc_id", "text").mapInArrow(loop_words, "doc_id long, text string").count() == 0


# ---- the audit's SQL on odd rows ----


def test_audit_sql_on_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.withColumn("text", F.substring("text", 1, 3000)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, wanted = op12_filter_audit(spark, str(tmp_path)).toPandas(), con.sql(OP12_SQL).df()
    assert as_rows(got, sorted(got.columns)) == as_rows(wanted, sorted(wanted.columns))
