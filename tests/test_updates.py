"""Stored tables, scores and renames against doing everything again, one by one."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from listwright.operators import renames, rescore, resolve, store
from listwright.plans.fixtures import companies, jobs
from listwright.plans.queries import LEXICON
from listwright.plans.updates import TAXONOMY

FOLDER = "/root/testdata/sf0.001"


def test_updates_rewrite_what_they_touch(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 2000).alias("company"), F.col("id").alias("job"), F.lit("old").alias("title"))
    kept = store.Store(str(tmp_path), "company", 200)
    kept.create(rows)
    assert sorted(kept.read(spark).collect()) == sorted(rows.collect())
    some = rows.where("company < 20")
    said = kept.update(some, lambda old: old.withColumn("title", F.when(F.col("company") < 20, "new").otherwise(F.col("title"))))
    assert said["version"] == 1 and said["buckets"] == 200 and 10 <= said["touched"] <= 20  # 1 % of companies, at most 20 of 200 buckets
    wanted = sorted(rows.withColumn("title", F.when(F.col("company") < 20, "new").otherwise(F.lit("old"))).collect())
    assert sorted(kept.read(spark).collect()) == wanted
    written = spark.read.parquet(f"{tmp_path}/data/version=1").select("bucket").distinct().count()
    assert written == said["touched"] and kept.changes(spark, 1).count() == some.count()
    plan = kept.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "version" in plan

    def fails(old):
        return old.withColumn("title", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        kept.update(some, fails)
    assert sorted(kept.read(spark).collect()) == wanted  # the old table, as it was
    with pytest.raises(ValueError, match="keys that the changes"):
        kept.update(rows.where("company = 1"), lambda old: rows.where("company < 500").withColumn("title", F.lit("x")))
    assert sorted(kept.read(spark).collect()) == wanted
    kept.update(rows.where("company in (1, 1999)"), lambda old: old.where("company not in (1, 1999)"))
    assert sorted(kept.read(spark).collect()) == [r for r in wanted if r["company"] not in (1, 1999)]
    kept.update(rows.limit(0), lambda old: old)
    assert kept.read(spark).count() == 40_000 - 40
    with pytest.raises(ValueError, match="bucket"):
        store.Store(str(tmp_path / "x"), "company", 4).create(rows.withColumn("bucket", F.lit(1)))


def test_incremental_scores_like_all(spark, tmp_path):
    now, own = jobs(spark, FOLDER), companies(spark, FOLDER)
    before = now.withColumn("title", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("title"))).where("id % 11 <> 5")
    rescore.rescored(before, own, LEXICON, TAXONOMY).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    some = rescore.rescored(now, own, LEXICON, TAXONOMY, stored)
    whole = rescore.rescored(now, own, LEXICON, TAXONOMY)
    columns = ["id", *rescore.SCORES, "mark"]
    assert sorted(map(str, some.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    n = {r["skipped"]: r["count"] for r in some.groupBy("skipped").count().collect()}
    expected = now.where("company_id is not null and id % 7 <> 0 and id % 11 <> 5").count()
    assert n[True] == expected and n[False] == whole.count() - expected
    again = rescore.rescored(now, own, LEXICON, TAXONOMY, whole)
    assert again.where("not skipped").count() == 0
    other = rescore.rescored(now, own, LEXICON, rescore.Taxonomy(TAXONOMY.strong, TAXONOMY.weak), whole)
    assert other.where("skipped").count() == 0  # another model scores all


def test_renames_against_greedy(spark):
    rng = random.Random(9)
    words = ["audio", "sound", "acme", "nord", "wave", "labs", "studio", "harman", "pulse", "echo"]
    old = [(f"o{i}", " ".join(rng.sample(words, 3)), rng.choice([f"https://x/{i}", None, "https://same"]), f"b{rng.randrange(60)}") for i in range(60)]
    new = []
    for i, (_, name, url, b) in enumerate(rng.sample(old, 45)):
        letters = list(name)
        if rng.random() < 0.6:
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz")
        new.append((f"n{i}", "".join(letters), url if rng.random() < 0.5 else None, b if rng.random() < 0.5 else f"c{i}"))
    new += [(f"m{i}", " ".join(rng.sample(words, 3)), "", None) for i in range(10)]
    schema = "slug string, name string, url string, board string"
    got = renames.renames(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "slug", "name", {"url": 3, "board": 2}).collect()

    def only(rows, i):
        values = [r[i].strip().lower() for r in rows if r[i] and r[i].strip()]
        return {r[i].strip().lower(): r[0] for r in rows if r[i] and values.count(r[i].strip().lower()) == 1}

    pairs = {}
    for i, weight, by in ((2, 3.0, "url"), (3, 2.0, "board")):
        a, b = only(old, i), only(new, i)
        for v in set(a) & set(b):
            pairs[a[v], b[v]] = max(pairs.get((a[v], b[v]), (0, "")), (weight, by))
    for o, x, *_ in old:
        for n, y, *_ in new:
            r = difflib.SequenceMatcher(None, x, y).ratio()
            if r >= renames.SIMILAR:
                pairs[o, n] = max(pairs.get((o, n), (0, "")), (r, "name"))
    wanted, taken = [], set()
    for (o, n), (s, by) in sorted(pairs.items(), key=lambda x: (-x[1][0], x[0])):
        if not {o, n} & taken:
            wanted.append((o, n, round(s, 6), by))
            taken |= {o, n}
    assert sorted((r["old"], r["new"], round(r["score"], 6), r["by"]) for r in got) == sorted(wanted) and len(wanted) > 30
    assert renames.renames(spark.createDataFrame([], schema), spark.createDataFrame(new, schema), "slug", "name", {"url": 3}).count() == 0


def test_related_companies_against_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8)))
    held = [(i, rng.randrange(60) if i % 9 else None, [word() for _ in range(rng.randrange(0, 3))]) for i in range(80)]
    own = [(i, [word() for _ in range(rng.randrange(0, 3))]) for i in range(50)]
    a, b = spark.createDataFrame(held, "k int, owner int, t array<string>"), spark.createDataFrame(own, "c int, n array<string>")
    got = {r["k"]: (r["own_related"], r["other"]) for r in resolve.related_companies(a, b, "k", "owner", "t", "c", "n").collect()}

    def related(xs, ys):
        return any(x == y or (min(len(x), len(y)) >= 4 and (x in y or y in x)) or (min(len(x), len(y)) >= 5 and x[:5] == y[:5]) for x in xs for y in ys)

    for k, owner, t in held:
        mine = dict(own).get(owner, [])
        others = [c for c, n in own if c != owner and related(t, n)]
        assert got[k] == (related(t, mine), min(others, default=None)), (k, owner, t)
    assert sum(x is not None for _, x in got.values()) > 30


def test_candidates_follow_the_tokens(spark):
    """A beginning that all share makes a row a token, not a row a pair."""
    a = spark.range(2000).select("id", (F.col("id") % 7).alias("owner"), F.array(F.concat(F.lit("customer"), "id")).alias("t"))
    b = spark.range(3000).select(F.col("id").alias("c"), F.array(F.concat(F.lit("customer"), "id")).alias("n"))
    rows = resolve.related_companies(a, b, "id", "owner", "t", "c", "n")
    assert rows.where("own_related and other = if(owner = 0, 1, 0)").count() == 2000
