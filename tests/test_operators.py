from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listwright.functions import arrays, country, salary, text, titles
from listwright.operators import discovery, history, normalize, resolve, scoring, seed
from listwright.sources import boards, tables
from listwright.streaming import log


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_entities_to_a_fixpoint(spark):
    row = one(spark, a=text.clean_description(F.lit("caf&amp;eacute; &#8217; &lt;p&gt;x&lt;/p&gt;")), b=text.clean_description(F.lit(None).cast("string")), c=text.clean_description(F.lit("<br>")))
    assert (row["a"], row["b"], row["c"]) == ("café ’ \nx".replace(" \n", "\n"), None, None)


def test_seniority_of_stage_titles(spark):
    said = {"Stage Manager": "manager", "Stage Technician": "mid", "Stage": "internship", "Stage Ingénieur": "internship", "Backstage Lead": "lead", "Duales Studium Akustik": "internship", "Interne Revision": "mid"}
    rows = spark.createDataFrame(list(said), "string").select("value", text.seniority(F.col("value")).alias("s")).collect()
    assert {r["value"]: r["s"] for r in rows} == said


def test_phrases_are_runs_of_words(spark):
    row = one(spark, p=country.phrases(country.segments(F.lit("Great New York City area"))))
    words = "great new york city area".split()
    assert set(row["p"]) == {" ".join(words)} | {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    assert one(spark, p=country.phrases(country.segments(F.lit(""))))["p"] == []


def test_arrays_are_trimmed(spark):
    row = one(spark, u=arrays.distinct_urls(F.array(F.lit(" https://a.example.com/ "), F.lit("https://A.example.com"), F.lit("x"), F.lit(None).cast("string"))), f=arrays.fetch_urls(F.lit(" https://a "), F.array(F.lit("https://b "), F.lit("https://a/"))))
    assert row["u"] == ["https://a.example.com/"] and row["f"] == ["https://a", "https://b"]


def test_seed_files(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps([{"name": "A", "url": None}, {"name": "B"}], indent=2))
    rows = tables.seed_entries(spark, str(path)).select("place", tables.seed_value("entry", "name").alias("name"), tables.has_key("entry", "url").alias("has")).orderBy("place").collect()
    assert [(r["place"], r["name"], r["has"]) for r in rows] == [(0, "A", True), (1, "B", False)]
    seed.write(spark.createDataFrame([("b", 1), (" A", 2), (None, 3)], "name string, v long"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    golden = tmp_path / "golden.json"
    golden.write_text('[{"title": "x", "acceptable": ["a"]}, {"title": null}]')
    assert tables.golden_cases(spark, str(golden)).count() == 1


def test_row_pipeline(spark):
    lexicon = scoring.Lexicon(strong={"mixing": ["mixing"]}, weak={}, title_strong=r"(?i)\bmixing\b", dominance={"mixing": ["other"]})
    rows = [
        (1, " Senior Mixing Engineer (m/w/d) ", "u1 ", "Pay $50,000 - $60,000. This is a fully remote position.", " Berlin, ", None, True),
        (2, "Clerk", "u2", None, None, "Part time", None),
        (3, "", "u3", "", "", "", False),
    ]
    raw = spark.createDataFrame(rows, "id long, title string, url string, description string, location string, job_type string, remote_hint boolean").withColumns({"audio_scope": F.lit("native"), "company_category": F.lit("DAW"), "company_name": F.lit(None).cast("string"), "posted_date": F.lit(None).cast("date")})
    got = {r["id"]: r for r in normalize.normalize(raw, lexicon, ["mixing", "music"], domains={"DAW": "music"}).collect()}
    a, b, e = got[1], got[2], got[3]
    assert (a["title"], a["url"], a["location"], a["seniority"], a["remote"], a["salary_min"], a["salary_max"]) == ("Senior Mixing Engineer", "u1", "Berlin", "senior", True, 50_000, 60_000)
    assert a["job_categories"] == ["mixing", "music"] and a["is_audio_related"] and a["relevance_score"] == 60 + 35 + 10
    assert (b["job_type"], b["remote"], b["is_audio_related"], b["relevance_score"]) == ("part-time", False, False, 0)
    assert (e["title"], e["location"], e["seniority"]) == ("", None, "mid")
    assert normalize.normalize(raw.limit(0), lexicon, ["mixing"]).count() == 0


def test_name_matching_stages(spark):
    known = ["Acme Audio Systems", "Borealis Instruments", "Cedar", "Deltawave Acoustic Laboratories"]
    asked = {"ACME AUDIO SYSTEMS GmbH": "Acme Audio Systems", "Acme Systems Audio Berlin": "Acme Audio Systems", "Cedar Music": "Cedar", "Deltawave Acoustic Laboratorys": "Deltawave Acoustic Laboratories", "Borealis Instrument": "Borealis Instruments", "Zed": None, "Unknown Firm": None}
    got = resolve.match_names(spark.createDataFrame(list(asked), "string").toDF("name"), spark.createDataFrame(known, "string").toDF("name")).collect()
    assert {r["name"]: r["matched"] for r in got} == asked


def test_ranks_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise(F.lit("hot")).alias("k"), "id")
    got = {(r["k"], r["id"]): r["n"] for r in history.ranked(rows, "k", ["id"]).collect()}
    wanted, seen = {}, {"rare": 0, "hot": 0}
    for i in range(3000):
        k = "rare" if i % 3 == 0 else "hot"
        seen[k] += 1
        wanted[k, i] = seen[k]
    assert got == wanted


def test_rate_limit_stream_ends_and_agrees(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hits = [("a", start + timedelta(hours=h)) for h in (0, 1, 2, 3, 25, 26, 30)] + [("b", start)]
    spark.createDataFrame(hits, "who string, ts timestamp").write.parquet(str(tmp_path / "hits"))
    stream = log.rate_limited(spark.readStream.schema("who string, ts timestamp").parquet(str(tmp_path / "hits")), "who", "ts")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    got = {(r["key"], r["ts"]): r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted, recent = {}, {}
    for who, ts in sorted(hits):
        kept = [t for t in recent.get(who, []) if t > ts - timedelta(days=1)]
        wanted[who, ts] = len(kept) < 3
        recent[who] = [*kept, ts] if len(kept) < 3 else kept
    assert got == wanted and not all(wanted.values())
    numbered = spark.createDataFrame([(w, t, i) for i, (w, t) in enumerate(hits)], "who string, ts timestamp, n long")
    batch = {r["place"]: r["admitted"] for r in log.batch_admitted(numbered, "who", "ts", "n").collect()}
    assert batch == {i: wanted[h] for i, h in enumerate(hits)}



def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.example.com", None), (2, None, "")], "page_id long, url string, html string")
    assert discovery.discover(pages).count() == 0
    assert {r["page_id"]: r["links"] for r in discovery.careers_links(pages).collect()} == {1: None, 2: []}
    assert discovery.open_applications(pages).count() == 0


def test_featuring_is_kept(spark):
    from listwright.functions.money import featured_since

    day = F.lit(date(2024, 1, 10))
    row = one(spark, live=featured_since(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 10)), day), over=featured_since(F.lit(date(2023, 1, 1)), F.lit(date(2023, 2, 1)), day), new=featured_since(F.lit(None).cast("date"), F.lit(None).cast("date"), day))
    assert (row["live"], row["over"], row["new"]) == (date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 10))


def test_boards_of_odd_payloads(spark):
    """Nulls, text that is no JSON, other shapes and empty lists give no row; a missing tenant column is told."""
    odd = [None, "", "not json", "[]", "{}", "null", '{"jobs":null}', '{"jobs":{}}', '{"jobs":["x",1,null]}', '{"jobs":[{"title":" ","absolute_url":"u"}]}', '[{"text":null}]', '{"content":[[]]}']
    frame = spark.createDataFrame([(i, x, "a", "b") for i, x in enumerate(odd)], "k int, payload string, slug string, host string")
    tenants = {x for b in boards.BOARDS.values() for x in b.tenant}
    frame = frame.withColumns({x: F.lit("2024-01-01").cast("date" if x == "as_of" else "string") for x in tenants})
    for name in ("greenhouse", "lever", "smartrecruiters", "taleo", "sigma", "jobsyn", "apple", "awsm"):
        assert boards.postings(frame, name, ["k"]).count() == 0, name
    with pytest.raises(ValueError, match="slug"):
        boards.postings(frame.drop("slug"), "bamboohr", ["k"])
    assert boards.postings(frame.limit(0), "lever", ["k"]).count() == 0


def test_remote_offers():
    said = {"This is a fully remote role.": True, "not a remote position": False, "on site or remote": False, "hybrid or remote": True, "Remote - United States": True, "The role can be fully remote": True, "U.S.-remote": True, "no. Then remote job": True, "remote support": False, "remote job. This is not": False, "telecommuting ok": True, "remote in the US": True, "": False}
    assert {k: text.says_remote(k) for k in said} == said


def test_gender_marks():
    wanted = {"Sound Engineer (m/w/d)": "Sound Engineer ", "Ingénieur H/F": "Ingénieur ", "Entwickler:in": "Entwickler", "Entwickler*innen Audio": "Entwickler Audio", "C++ Entwickler_in": "C++ Entwickler", "Engineer (Audio/DSP)": "Engineer (Audio/DSP)", "A/V Tech": "A/V Tech", "Dev (f / m / x) 2": "Dev  2"}
    assert {k: text.unmarked(k) for k in wanted} == wanted


def test_salaries():
    wanted = {
        "$50,000 - $60,000": (50000, 60000, "USD"), "50k-60k EUR": (50000, 60000, "EUR"), "£30/hour": (62400, None, "GBP"), "100 to 200": (None, None, None), "$25 – $35 an hour": (52000, 72800, "USD"),
        "pay: USD 80,000–90,000": (80000, 90000, "USD"), "80000 and 90000 CHF": (80000, 90000, "CHF"), "$120k+ USD": (120000, None, "USD"), "from $5": (None, None, None), "$60 to 70k": (60000, 70000, "USD"), "20,000 and 30,000": (20000, 30000, None), "": (None, None, None),
        "room 12, $90,000, then $1 to $2": (90000, None, "USD"),
    }
    assert {k: salary.salary(k) for k in wanted} == wanted
