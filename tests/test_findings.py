"""Tests of the third round's findings."""

from __future__ import annotations

import difflib
from random import Random

import pytest
from pyspark.sql import functions as F

from listwright.functions import dates, money, text
from listwright.operators import extract, keywords, normalize, proposals, ranked_pages, rescore, resolve, scoring
from listwright.plans.board_payloads import PAYLOADS
from listwright.plans.fixtures import companies, jobs
from listwright.plans.queries import LEXICON
from listwright.plans.registry import QUERIES
from listwright.plans.updates import TAXONOMY
from listwright.sources import boards

from .test_queries import FOLDER


def test_similar_names_meet_few_others(spark, monkeypatch):
    """Names of one shape with another number are no candidates; before, each met every other."""
    ours = spark.range(300).selectExpr("concat('no 00000', lpad(id, 4, '7'), ' such firm x', id) AS a")
    theirs = spark.range(300).selectExpr("concat('building audio 00000', lpad(id, 4, '7')) AS b")
    monkeypatch.setattr(resolve, "ratio", lambda a, b: F.lit(1.0))
    assert resolve.similar_names(ours, theirs, "a", "b", 0.92).count() < 300


def test_similar_names_like_all_pairs(spark):
    """No similar pair is missed, whatever is put in, left out or changed."""
    dice, names, others = Random(3), [], []
    for _ in range(60):
        name = "".join(dice.choice("abcd ") for _ in range(dice.randint(3, 25)))
        names.append(name)
        for _ in range(3):
            letters = list(name)
            for _ in range(dice.randint(0, 3)):
                at = dice.randrange(len(letters) + 1)
                letters[at : at + dice.randint(0, 1)] = dice.choice(("", "x", "a"))
            others.append("".join(letters))
    names, others = sorted(set(names)), sorted(set(others) - {""})
    for least in (0.92, 0.8):
        wanted = {(x, y) for x in names for y in others if difflib.SequenceMatcher(None, x, y).ratio() >= least}
        got = resolve.similar_names(spark.createDataFrame([(x,) for x in names], "a string"), spark.createDataFrame([(y,) for y in others], "b string"), "a", "b", least).collect()
        assert {(r["a"], r["b"]) for r in got} == wanted
        assert len(got) == len(wanted)


def test_entities_of_stripped_pages_end_with_a_semicolon(spark):
    rows = spark.createDataFrame([("<p>a&amp b &ampx; &#38; R&D &amp;quot;</p>",)], "html string")
    got = rows.select(text.strip_html(F.col("html")).alias("plain"), text.sanitize_html(F.col("html")).alias("safe")).first()
    assert got["plain"] == 'a&amp b &ampx; & R&D "'
    assert got["safe"] == '<p>a&amp b &ampx; & R&D "</p>'


def test_entities_of_main_texts_end_with_a_semicolon(spark):
    html = '<article>a&amp b &lt;i&gt; R&D<a href="/x?a=1&amp;b=2&c=3">l</a></article><script type="application/ld+json">{"a":"R&D &amp x"}</script>'
    rows = {r["kind"]: r for r in extract.page_rows(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"]).collect()}
    assert rows["main"]["text"] == "a&amp b <i> R&D l"
    assert rows["link"]["href"] == "/x?a=1&b=2&c=3"
    assert rows["data"]["text"] == '{"a":"R&D &amp x"}'


@pytest.mark.parametrize("name", ["board_details", "board_payloads", "page_trees", "board_pages", "careers_links", "url_audit"])
def test_small_rows_of_much_work_are_dealt(spark, name):
    """Rows of a small file are dealt over all tasks before the work on them; before, one task did it."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_rank_index_is_written_by_few_tasks(spark, tmp_path):
    """However many ranges an index has, the tasks that write them are as many as other shuffles have; before, one a range."""
    rows, order = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("id")), [F.col("id").asc()]
    index = ranked_pages.build(rows, order, str(tmp_path / "r"), range_rows=10)
    assert len([n for n in index.sizes if n]) >= 300 and index.total_rows == 3000
    files = [x.name for x in (tmp_path / "r" / "rows").glob("*/*.parquet")]
    assert len({x.split("-")[1] for x in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r["id"] for r in ranked_pages.page(spark, index, order, 17, 20).collect()] == sorted(r["id"] for r in rows.collect())[320:340]


def test_fences_take_no_python(spark):
    """A fence keeps projections apart without a Python process of its own; before, each had one a task."""
    twice = normalize.fenced(spark.range(5).select((F.col("id") + F.rand()).alias("x"))).select((F.col("x") + F.col("x")).alias("y"))
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "CollectMetrics" in plan
    assert twice.count() == 5


def test_each_found_text_is_scored_once(spark, monkeypatch):
    """Postings of one text go through the model together; before, each row did. Nulls and free names are kept."""
    text = F.element_at(F.array(F.lit("Bolt maker"), F.lit("Clerk"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    found = spark.range(900).select(F.col("id").alias("place"), F.concat(F.lit("Firm "), F.col("id") % 4, F.lit(" Ltd")).alias("company_name"), text.alias("title"), F.when(F.col("id") % 2 == 0, "x").alias("description"), none.alias("location"), F.lit("t").alias("search_term"), none.alias("country"), none.alias("company_url"))
    scored, classify = [], proposals.classify

    def counted(rows, *args, **kwargs):
        scored.append(rows.count())
        return classify(rows, *args, **kwargs)

    monkeypatch.setattr(proposals, "classify", counted)
    model = scoring.Lexicon(strong={}, weak={}, title_strong=r"(?i)\bbolt")
    got = proposals.new_companies(found, spark.createDataFrame([("FIRM 2",)], "name string"), model, keywords.Taxonomy({})).collect()
    assert scored == [6]
    assert [(r["normalized_name"], r["name"], r["hit_count"], r["search_terms"], r["titles"]) for r in got] == [(f"firm {i}", f"Firm {i} Ltd", 75, ["t"], ["Bolt maker"]) for i in (0, 1, 3)]


def test_row_pipeline_has_few_python_processes(spark):
    """Each Python step of a task's plan is a process of its own; before, a text was cleaned twice and each step stood alone."""
    steps = lambda rows: rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert steps(QUERIES["normalized_jobs"](spark, FOLDER)) == 1
    assert steps(rescore.rescored(jobs(spark, FOLDER), companies(spark, FOLDER), LEXICON, TAXONOMY)) == 2


def test_names_are_matched_without_broadcasts(spark):
    """Tables of names aren't sent through the driver, however small; before, a match held a dozen of them there, each of 32 MB at least."""
    known = spark.createDataFrame([("Acme Audio Systems",), ("Acme  Audio Systems Ltd",), ("Cedar",), ("Deltawave Acoustic Laboratories",)], "name string")
    asked = spark.createDataFrame([("ACME Audio Systems Inc",), ("Systems Audio",), ("Cedar Music",), ("Deltawave Acoustic Laboratorys",), ("Ltd",), (None,)], "name string")
    rows = resolve.match_names(asked, known)
    got = {r["name"]: r["matched"] for r in rows.collect()}
    assert got == {"ACME Audio Systems Inc": "Acme  Audio Systems Ltd", "Systems Audio": "Acme  Audio Systems Ltd", "Cedar Music": "Cedar", "Deltawave Acoustic Laboratorys": "Deltawave Acoustic Laboratories", "Ltd": None, None: None}
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_values_of_a_posting_are_read_once(spark):
    """A payload is parsed once and its postings are read in one go; before, it was parsed twice and a value read wherever it was named."""
    for name, (tenant, _, _) in PAYLOADS.items():
        columns = [F.lit(v).cast("date" if k == "as_of" else "string").alias(k) for k, v in tenant.items()]
        plan = boards.postings(spark.range(3).select("id", F.format_string("[%s]", "id").alias("payload"), *columns), name, ["id"])._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("CollectMetrics") :]
        assert plan.count("parseJson(") == 1, name
        assert plan.count(", ArrayType(StructType(") == len(boards.BOARDS[name].rows), name


def test_values_asked_for_in_several_ways(spark, monkeypatch):
    """A place that is read as a text and for what is below it, names that differ in capitals, and values of other types than usual."""
    board = boards.Board(("$.jobs", "$"), boards.at("$.Name"), boards.at("$.name", "$.x[0].u"), boards.at("$.x[1].u"), boards.first(boards.said("$.l"), boards.at("$.l.city", "$.l")), boards.each("$.x", boards.at("$.u")), inner="$.d")
    monkeypatch.setitem(boards.BOARDS, "odd", board)
    items = ['{"Name":" a ","name":"u1","l":"here"}', '{"Name":2.50,"x":[{"u":"u2"},{"u":true}],"l":{"city":"Ulm"}}', '{"Name":{"b":1},"x":[{"u":7}],"l":[3]}', '{"Name":"none","x":{"u":7}}', "[1]", "null"]
    listed = ",".join(f'{{"d":{x}}}' for x in items) + ',5,{"d":5},{}'
    rows = [(1, f'{{"jobs":[{listed}]}}'), (2, f"[{listed}]"), (3, '{"jobs":'), (4, None)]
    got = boards.postings(spark.createDataFrame(rows, "k int, payload string"), "odd", ["k"]).orderBy("k", "place").collect()
    wanted = [(0, "a", "u1", None, "here", None), (1, "2.5", "u2", "true", "Ulm", "u2; true"), (2, '{"b":1}', "7", None, "[3]", "7")]
    assert [tuple(r)[:7] for r in got] == [(k, place, title, url, i, where, text) for k in (1, 2) for place, title, url, i, where, text in wanted]


def test_dates_are_tried_where_they_may_be(spark):
    """Guards keep texts from forms that they can't have; what is read stays."""
    said = {"March 3, 2024": 1, "Mar 3, 2024": 1, "may 3, 2024": 1, "3 June 2024": 1, "3 Jun 2024": 1, "03/05/2024": 1, "03.05.2024": 1, "Tue Mar 05 00:00:00 UTC 2024": 1, "Mar 03, 2024": 1, "Oslo": 0, "": 0, "3. March 2024": 0, "Mar. 3, 2024": 0}
    got = spark.createDataFrame([(x,) for x in said], "t string").select("t", money.written_date(F.col("t")).isNotNull().cast("int").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == said
    read = {"2024-01-05": "2024-01-05", "1704412800": "2024-01-05", "1.7044128e9": "2024-01-05", "1704412800000": "2024-01-05", "17044128000e-1": "2024-01-05", "5-": None}
    got = spark.createDataFrame([(x,) for x in read], "t string").select("t", dates.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == read
