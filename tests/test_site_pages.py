"""Entries of pages by rules: a page with all there is, pages that are broken, and a whole table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import site_pages as S

PAGE = """<html><body><a href="/nav/1">nav</a>
<div class="list_item row"><a href="/board/12?x=1"><span class="subject">First  post - Site</span></a><span class="hit">1,234</span><span class="reply">[5]</span><span class="up">-</span><b class="time">2026-04-19 21:30:00</b><i class="nick"><u>A</u>nn</i></div>
<div class="list_item row"><a href="https://other.example.org/board/13"><span class="subject">Elsewhere</span></a><b class="time">2026-04-19 21:30</b></div>
<div class="list_item row"><span class="subject">No link</span></div>
<div class="list_item row"><a href="/board/14"><span class="subject">Old</span></a><b class="time">2026-04-10 00:00:00</b></div>
<div class="list_item row"><a href="/board/12"><span class="subject">Repeated</span></a></div>
<div class="list_item"><a href="/board/15"><span class="subject">Of another list</span></a></div>
<div class="list_item row"><a href="/board/16"><p><span class="subject">Ｗｉｄｅ<br>title</div>
<p>rest</p>"""
RULES = [
    ("site", "example.com", "div.list_item.row", "span.subject", ".nick", "b.time", "span.hit", ".up", ".reply", r"/(\d+)(?:\?|$)", "Asia/Seoul", ["- Site", "| X"]),
    ("bbs", "bbs.example.com", "li", "a", None, None, None, None, None, None, None, None),
]


def posts(spark, pages, **kw):
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    return sorted(S.posts_of(p, spark.createDataFrame(RULES, S.RULE), **kw).collect(), key=lambda r: (r["page_id"], r["external_id"] or ""))


def test_a_page(spark):
    got = posts(spark, [(1, "https://www.example.com/list?p=1", PAGE)])
    assert [(r["external_id"], r["title"], r["link"]) for r in got] == [("12", "First post", "https://www.example.com/board/12?x=1"), ("13", "Elsewhere", "https://other.example.org/board/13"), ("14", "Old", "https://www.example.com/board/14"), ("16", "Widetitle", "https://www.example.com/board/16")]
    first = got[0]
    assert (first["views"], first["comments"], first["likes"], first["author"], first["source"]) == (1234, 5, 0, "Ann", "site")
    assert first["posted_at"] == datetime(2026, 4, 19, 12, 30)  # 21:30 in Seoul
    assert all(r["error"] is None for r in got)
    kept = posts(spark, [(1, "https://www.example.com/list?p=1", PAGE)], as_of="2026-04-20 00:00:00", own_host=True)
    assert [r["external_id"] for r in kept] == ["12", "16"]


def test_broken_pages(spark):
    pages = [(1, "https://example.com/", None), (2, "https://example.com/", "  "), (3, "https://example.com/", "<<div <a href='x"), (4, "https://nowhere.org/", PAGE), (5, None, PAGE), (6, "https://a.bbs.example.com/x/", "<ul><li><a href='y#z'>one</a><li><a href='/y'>two</a></ul>"), (7, "https://[bad/", PAGE), (8, "https://bbs.example.com/", "<li><a href='http://[::1'>bad link</a></li>")]
    got = posts(spark, pages)
    assert [(r["page_id"], r["error"]) for r in got if r["error"]] == [(1, "no page"), (2, "no page"), (3, "no items parsed"), (8, next(r["error"] for r in got if r["page_id"] == 8))]
    assert [(r["page_id"], r["title"], r["link"]) for r in got if not r["error"]] == [(6, "one", "https://a.bbs.example.com/x/y#z")]
    assert posts(spark, []) == []


@pytest.mark.parametrize("text,n", [("1,234", 1234), ("[5]", 5), ("-", 0), (None, 0), ("-3", -3), ("1-2", 0), ("9" * 30, 0)])
def test_counters(text, n):
    assert S.count_of(text) == n


def test_a_table_of_pages(spark):
    """Against a pattern that holds for these pages: every link of a list, once a site and address."""
    import re
    from urllib.parse import urljoin, urlsplit

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rules = spark.createDataFrame([(h, h, "li", "a", None, None, None, None, None, None, None, None) for h in ("example.com", "example.net", "example.org")], S.RULE)
    got = S.posts_of(pages, rules)
    want = {}
    for r in pages.orderBy("page_id").collect():
        host = urlsplit(r["url"]).hostname
        site = next((s for s in ("example.com", "example.net", "example.org") if host and (host == s or host.endswith("." + s))), None)
        for href, title in re.findall(r'<li><a href="([^"]*)">([^<]*)</a></li>', r["html"] or ""):
            if site and title.strip():
                want.setdefault((site, urljoin(r["url"], href)), r["page_id"])
    assert {(r["source"], r["external_id"]): r["page_id"] for r in got.filter("error is null").collect()} == want and len(want) > 50
    assert got.filter(F.col("error").isNotNull()).select("page_id").distinct().count() == got.filter(F.col("error").isNotNull()).count()
