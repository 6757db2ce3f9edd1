"""Requests, seed files, probe caches, board discovery and dry runs."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from listwright.operators import check, discovery, keywords, requests, seed
from listwright.operators.extract import LinkWords
from listwright.operators.scoring import Lexicon
from listwright.sources import tables


def test_request_values():
    assert requests.ids(None) is None and requests.ids("") == [] and requests.ids("1, 2,x,-3, 44") == [1, 2, 44] and requests.ids("1,2,3", most=2) == [1, 2]
    assert requests.words(" a,,b ") == ["a", "b"] and requests.words(" , ") is None and requests.words(None) is None
    assert requests.grades("", ("thin",)) == ["thin"] and requests.grades("idle, thin", ()) == ["idle", "thin"]
    with pytest.raises(ValueError, match="odd"):
        requests.grades("odd", ())
    env = {"A": "7", "B": "x", "C": "1.5"}
    assert (requests.setting(env, "A", 1), requests.setting(env, "B", 2), requests.setting(env, "C", 1.0), requests.setting(env, "D", 4)) == (7, 2, 1.5, 4)
    assert requests.company_seconds(True) == 180 and requests.company_seconds(False, 10) == 10


def test_board_urls():
    got = requests.board_params("/jobs?q=mix&category=a,b&category=b&category=&salary_min=-5&sort=oldest&page=x&evil=1&remote=true&per_page=3")
    assert got == {"per_page": "3", "search": "mix", "category": "a,b", "sort": "oldest", "remote": "true", "page": "1"}
    f = requests.board_filter(got)
    assert (f.category, f.search, f.remote, f.salary_min, f.job_type) == (("a", "b"), "mix", True, None, None)
    assert requests.board_params("")["page"] == "1" and requests.board_params("?page=-4")["page"] == "1" and requests.board_params("?salary_min=900&page=3") == {"per_page": "20", "salary_min": "900", "page": "3"}


def test_seed_file(spark, tmp_path):
    columns = "name string, url string, was string, place int"
    entries = spark.createDataFrame([("Beta", "b"), ("acme", "a")], "name string, url string")
    file = seed.SeedFile(str(tmp_path / "seed"))
    file.create(entries)
    assert file.sync(spark.createDataFrame([("Acme ", "a2", None, 1), ("Gamma", "g", "beta", 2)], columns)) == 1
    assert [tuple(r) for r in file.read(spark).collect()] == [("Acme ", "a2"), ("Gamma", "g")]
    assert file.forget(spark.createDataFrame([("GAMMA",)], "name string")) == 2
    open(tmp_path / "seed" / "lock", "w").close()
    with pytest.raises(TimeoutError, match="lock"):
        seed.SeedFile(str(tmp_path / "seed"), wait=0.2).forget(spark.createDataFrame([("x",)], "name string"))
    (tmp_path / "seed" / "lock").unlink()
    # writers at once: each one's change is there in the end
    threads = [threading.Thread(target=lambda i=i: file.sync(spark.createDataFrame([(f"n{i}", str(i), None, 1)], columns))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["name"] for r in file.read(spark).collect()) == ["Acme ", "n0", "n1", "n2", "n3"]


def test_probe_cache(spark, tmp_path):
    def probe(i, html):
        return (i, f"c{i}", "u", None, 200, html, ["l"], [], 3, None)

    folder = str(tmp_path / "probes")
    assert tables.write_probes(spark.createDataFrame([probe(1, "a"), probe(2, None), probe(2, None)], tables.PROBE), folder) == 2
    assert tables.write_probes(spark.createDataFrame([probe(2, "new"), probe(3, 'x "\n')], tables.PROBE), folder) == 1
    got = {r["company_id"]: r["html"] for r in tables.page_cache(spark, folder).collect()}
    assert got == {1: "a", 2: None, 3: 'x "\n'}
    assert tables.write_probes(spark.createDataFrame([], tables.PROBE), folder) == 0


def test_boards_of_pages(spark):
    pages = {
        '<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme"></script>': [("greenhouse", "acme")], "https://boards.eu.greenhouse.io/beta": [("greenhouse", "beta")], "https://job-boards.greenhouse.io/Gamma/jobs/1": [("greenhouse", "gamma")],
        "https://boards.greenhouse.io/embed/job_board?for=delta": [("greenhouse", "delta")], "jobs.apple.com/en-us": [("apple", "")], "https://app.eightfold.ai/x": [("eightfold", "acme.co.uk")], "https://cdn.recruitee.com/a.png https://a-cdn.icims.com": [],
        "https://careers-x.icims.com/jobs https://x.wd5.myworkdayjobs.com/en-us/Ext": [("workday", "x.wd5/ext"), ("icims", "careers-x")], "nothing": [], "https://workforcenow.adp.com/a/b.html?x=1&cid=01234567-89ab-cdef-0123-456789abcdef": [("adp", "01234567-89ab-cdef-0123-456789abcdef")],
    }
    rows = spark.createDataFrame([(i, "https://jobs.acme.co.uk/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {}
    for r in sorted(discovery.discover(rows, url="url").collect(), key=lambda r: r["place"]):
        got.setdefault(r["page_id"], []).append((r["board"], r["slug"]))
    assert [got.get(i, []) for i in range(len(pages))] == list(pages.values())
    domains = {"https://a.b.acme.com/x": "acme.com", "http://acme.co.uk": "acme.co.uk", "https://u@www.acme.org:80?x": "acme.org", "acme.com": ""}
    got = {r["u"]: r["d"] for r in spark.createDataFrame([(u,) for u in domains], "u string").select("u", discovery.registered_domain(F.col("u")).alias("d")).collect()}
    assert got == domains


def test_dry_run(spark):
    long = "We mix sound. " * 40
    html = f"""<a href="/jobs/1">Sound Mixer</a><a href="/jobs/2">Accountant</a><a href="/about">About</a><a href="https://jobs.lever.co/acme">all</a>
    <script type="application/ld+json">{{"@type":"JobPosting","title":"Sound Mixer (m/w/d)","url":"/jobs/1","description":"{long}","datePosted":"2024-05-01","employmentType":"FULL_TIME","jobLocation":{{"address":{{"addressLocality":"Ulm"}}}}}}</script>"""
    pages = spark.createDataFrame([(1, "https://acme.com/careers", html, "native", "DAW", "Acme"), (2, "https://b.com/careers", "nothing here", "all", None, None)], "page_id long, url string, html string, audio_scope string, company_category string, company_name string")
    lexicon = Lexicon(strong={}, weak={}, title_strong=r"(?i)\bmixer\b", text_strong=r"mix")
    taxonomy = keywords.Taxonomy({"mixing": ("mixer",)})
    got = {r["page_id"]: r for r in check.dry_run(pages, lexicon, ["mixing"], taxonomy, words=LinkWords()).collect()}
    a = got[1]
    assert (a["total"], a["long_descriptions"], a["board_rows"], a["boards"]) == (2, 1, 1, ["lever:acme"])
    assert a["samples"] == ["Sound Mixer", "Accountant"]
    assert (got[2]["total"], got[2]["samples"], got[2]["boards"]) == (0, [], [])
