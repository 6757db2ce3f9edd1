from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from listwright.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

from tests.oracle import same  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_links_like_html_parser(spark):
    """Every page's links and titles against the standard library's parser."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.open, self.skip = [], None, 0

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.open = [dict(attrs).get("href") or "", ""]

        def handle_endtag(self, tag):
            if tag == "a" and self.open:
                self.found.append(self.open)
                self.open = None

        def handle_data(self, data):
            if self.open:
                self.open[1] += data

    wanted = {}
    for row in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        parser = Anchors()
        parser.feed(row["html"])
        for href, title in parser.found:
            if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
                key, title = (row["page_id"], urljoin(row["url"], href)), " ".join(title.split())
                if key not in wanted or len(title) > len(wanted[key]):
                    wanted[key] = title
    got = {(r["page_id"], r["link"]): r["title"] for r in QUERIES["page_links"](spark, FOLDER).collect()}
    assert got == wanted
