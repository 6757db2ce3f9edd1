from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from listwright.llm.common import saved, work_dir


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    work = work_dir(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), f"{work}/{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    kept, lined, joined, mixed = counts[1:]
    assert kept >= 0.99 * counts[0] and lined == kept and 0.6 * kept < joined < kept and mixed > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == mixed and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "bpe"]


def test_empty_table(spark, odd_docs):
    docs = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_copied_text_keeps_one_copy(spark):
    """Copies over many sources do not make a text's own lines boilerplate; a line of many different texts still is."""
    body = "\n".join(f"line {i} of a text that was copied to many other sources" for i in range(12))
    rows = [(i, body, "en", f"s{i}", len(body)) for i in range(15)]
    rows += [(100 + i, f"own words number {i} {i * i} of this page\nall rights reserved", "en", f"s{i}", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    work = work_dir(spark, "copies")
    lined = saved(stages["line_dedup"](spark, docs, ""), f"{work}/lined")
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert all(got[i] == body for i in range(15)) and all("reserved" not in got[100 + i] for i in range(10))
    left = {r["doc_id"]: r["text"] for r in stages["jaccard_join"](spark, lined, "").collect()}
    assert left[0] == body and not any(i in left for i in range(1, 15))


def test_odd_documents_through_all_stages(spark, odd_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names, from stage to stage."""
    names = ("__text", "__row", "__n", "__salt", "__gone", "__own", "__cdf", "own", "row", "rep", "n", "part")
    docs = odd_docs.withColumns({x: F.lit(i) for i, x in enumerate(names)})
    # more of one language, so that it can be learned
    more = spark.range(60).selectExpr("id + 1000 AS doc_id", "concat('the cat and the dog number ', id, ' sat on the mat of the house') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "1L AS n_chars", "'e' AS copy")
    docs = docs.unionByName(more.withColumns({x: F.lit(i) for i, x in enumerate(names)}))
    columns, work = docs.columns, work_dir(spark, "odd-stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, ""), f"{work}/{name}")
        # mixing has names of its own for a document's copies
        assert docs.columns == [c for c in columns if name != "mixing" or c != "copy"] or docs.columns == columns, name
        assert all(r["__text"] == 0 and r["part"] == len(names) - 1 for r in docs.select("__text", "part").collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.count() == docs.count() > 0
