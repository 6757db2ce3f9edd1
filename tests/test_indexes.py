"""The search index and rank indexes against full scans and full sorts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from listwright.functions import search as words
from listwright.operators import board, ranked_pages, search_index
from listwright.plans.listings import _board

FOLDER = "/root/testdata/sf0.001"


def test_search_like_a_scan(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["mix", "mixer", "mixing", "c++", "c#", ".net", "r&d", "audio", "Audio-DSP", "sound/design", "größe", "naïve", "x", "node.js", "100%", "über", "mixers"]
    rows = [(i if i % 50 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 5))) if i % 7 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, title string, body string")
    index = search_index.build(frame.withColumn("n", F.lit(1)), str(tmp_path / "i"), "id", ["title"], ["body"], files=5)
    kept = frame.where("id is not null")
    for text in ["mix", "mixin", "mixing audio", "c++", "c#", ".net", "r&d mix", "sound/design", "audio-dsp", "größe", "größ", "naïve x", "node.js", "100%", "üb", "mixer, mixers", "nothing", "", None, "&&", "audio mix mixer c# x"]:
        got = {(r["id"], r["rank"]) for r in search_index.search(spark, index, text).select("id", "rank").collect()}
        wanted = {(r["id"], r["rank"]) for r in kept.where(words.matches(text, [F.col("title")], [F.col("body")])).select("id", words.rank(text, [F.col("title")]).alias("rank")).collect()}
        assert got == wanted, text


def test_search_reads_its_words_only(spark, tmp_path):
    """Posting blocks read are those of the words; words and folders are found through pushed filters."""
    rows = spark.range(600_000).select("id", F.concat_ws(" ", F.when(F.col("id") % 100_000 == 7, "rare"), F.lit("common"), F.concat(F.lit("w"), F.col("id") % 1000)).alias("title"))
    index = search_index.build(rows, str(tmp_path / "i"), "id", ["title"], [], files=16)
    read = search_index.read_postings(spark, index, "rare common").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    assert (read["blocks"], read["n"]) == (6 + -(-600_000 // search_index.BLOCK), 600_006)
    assert search_index.read_postings(spark, index, "rare").agg(F.sum("n")).first()[0] == 6
    found = search_index.search(spark, index, "rare common")
    assert sorted(r["id"] for r in found.collect()) == [i * 100_000 + 7 for i in range(6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,rare)" in plan and "dynamicpruning" in plan.lower().replace("#", "")
    folders = search_index.candidates(spark, index, "rare common").select(F.floor(F.col("block") / search_index.BLOCKS_A_FOLDER)).distinct().count()
    assert folders <= 3
    assert search_index.build(rows.limit(0), str(tmp_path / "e"), "id", ["title"], []) and search_index.search(spark, search_index.SearchIndex(str(tmp_path / "i"), "id", ("title",), ()), "zzzz").count() == 0
    with pytest.raises(ValueError, match="folder"):
        search_index.build(rows.withColumn("folder", F.lit(1)), str(tmp_path / "f"), "id", ["title"], [])


@pytest.mark.parametrize("sort", ["newest", "oldest", "salary_desc", "salary_asc", "newest+us", "newest+search", "oldest+tail"])
def test_pages_like_full_sorts(spark, tmp_path, sort):
    rows = board.filter_jobs(_board(spark, FOLDER), board.JobFilter(include_unrelated=True)).select("id", "title", "company_name", "country", "job_type", "salary_min", "salary_max", "posted_date", "created_at")
    base, _, more = sort.partition("+")
    order = board.job_order(base, country_first="us" if more == "us" else None, search="bolt" if more == "search" else None, untyped_last=more == "tail")
    tail = F.col("job_type").isNull() if more == "tail" else None
    index = ranked_pages.build(rows, order, str(tmp_path / "r"), tail, range_rows=60)
    assert ranked_pages.opened(spark, str(tmp_path / "r")) == index and len(index.sizes) > 5
    n = rows.count()
    for number, size in ((1, 10), (2, 25), (7, 20), (-(-n // 30), 30), (n, 10), (0, 500)):
        got = ranked_pages.page(spark, index, order, number, size)
        wanted = board.page(rows, order, number, size, tail)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in wanted.select(*got.columns).orderBy(*order).collect()], (sort, number, size)
    assert len(index.ranges(7, 20)[0]) <= 2
    plan = ranked_pages.page(spark, index, order, 7, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan or "PartitionFilters: [isnotnull(range" in plan


def test_empty_rank_index(spark, tmp_path):
    rows = spark.range(0).withColumn("x", F.lit("a"))
    index = ranked_pages.build(rows, [F.col("id").asc()], str(tmp_path / "r"))
    assert ranked_pages.page(spark, index, [F.col("id").asc()], 1, 10).collect() == []
    with pytest.raises(ValueError, match="range"):
        ranked_pages.build(rows.withColumn("range", F.lit(1)), [F.col("id").asc()], str(tmp_path / "q"))
