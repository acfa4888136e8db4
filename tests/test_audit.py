"""The whole audit on a small site, landed answers, listings."""

import datetime as dt

from pyspark.sql import functions as F

from auditloom.operators import audit, listing
from auditloom.sources import answers

RESPONSES = "url string, final_url string, status int, html string, headers map<string,string>, response_time_ms double, error string, redirect_chain array<struct<from:string,to:string,status:int>>, depth int, alias_of string, duplicate_of string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def page(body, title="A title that is long enough"):
    return f'<html lang="en"><head><title>{title}</title><meta name="viewport" content="width=device-width"></head><body><h1>H</h1>{body}</body></html>'


def test_full_audit(spark):
    site = [
        ("https://e.com/", page('<a href="/b">b</a><a href="/">self</a>'), 200), ("https://e.com/b", page('<a href="/">home</a>', "Short"), 200),
        ("https://e.com/c", page("<p>alone</p>"), 404), ("https://e.com/gone", None, None),
    ]
    made = [(u, u, s, h, {"X": "1"}, 900.0, None if s else "timeout", [], 0, None, None) for u, h, s in site] + [("https://e.com/?x", "https://e.com/?x", 200, page(""), {}, 1.0, None, [], 1, "https://e.com/", None)]
    rule = {"id": 7, "name": "Long titles", "severity": "warning", "check": {"type": "field", "field": "title", "op": "length_gte", "value": "10"}}
    axe = spark.createDataFrame([("https://e.com/", "info", "A11Y_COLOR", "m", "axe")], "url string, severity string, code string, message string, source string")
    got = audit.full_audit(spark.createDataFrame(made, RESPONSES), [rule], {"accessibility": axe}, start="https://e.com/")
    found = {(r.url, r.code): r.source for r in got["issues"].collect()}
    assert found["https://e.com/b", "TITLE_TOO_SHORT"] == "html" and found["https://e.com/c", "STATUS_404"] == "response" and found["https://e.com/b", "CUSTOM_7"] == "rules"
    assert found["https://e.com/", "A11Y_COLOR"] == "axe" and found["https://e.com/gone", "FETCH_ERROR"] == "response" and ("https://e.com/", "CUSTOM_7") not in found
    assert not any(u == "https://e.com/?x" for u, _ in found) and ("https://e.com/gone", "MISSING_TITLE") not in found
    assert rows(got["orphans"].select("url")) == [("https://e.com/c",), ("https://e.com/gone",)]
    r = {x.code: x for x in got["recommendations"].collect()}
    assert r["ORPHAN_PAGES"].affected_pages == 2 and r["SLOW_TTFB"].affected_pages == 4 and r["CUSTOM_7"].recommendation.startswith("Long titles")
    assert got["health"].first().pages == 4 and got["page_scores"].count() == 4
    none = audit.full_audit(spark.createDataFrame([], RESPONSES))
    assert none["issues"].count() == none["recommendations"].count() == none["orphans"].count() == 0


def test_landed_answers(spark):
    one = lambda j, *k: spark.createDataFrame([(*k, x) for x in (j, "{broken", None, "[]", "{}")], ", ".join(f"c{i} string" for i in range(len(k))) + (", " if k else "") + "json string")
    s = answers.backlink_summaries(one('[{"rank":5,"backlinks":9}]', "t").withColumnRenamed("c0", "target")).collect()
    assert tuple(s[0]) == ("t", 5, 9, 0, 0) and s[1].rank is None
    assert rows(answers.keyword_difficulty(one('[{"items":[{"keyword":"A","keyword_difficulty":3},{"keyword":"b"},{"keyword_difficulty":1}]}]'))) == [("a", 3)]
    assert rows(answers.questions(one('{"items":[{"type":"people_also_ask","items":[{"title":"Why?"},{"title":"Why?"},{}]},{"type":"organic"}]}', "k").withColumnRenamed("c0", "keyword"))) == [("k", "Why?")]
    assert rows(answers.suggestions(one('["s",["one","two"," "],{}]', "s").withColumnRenamed("c0", "seed"))) == [("s", 0, "one"), ("s", 1, "two")]
    kept, long = answers.clean_keywords(spark.createDataFrame([(" A  b",), ("a b",), ("x" * 81,), (None,), ("",)], "keyword string"))
    assert rows(kept) == [("a b",)] and rows(long) == [("x" * 81,)]
    d = spark.createDataFrame([(dt.date(2025, 3, 31),)], "d date").select(answers.months_back(F.col("d"), 13).alias("m")).first().m
    assert d == dt.date(2024, 2, 1)
    urls = spark.createDataFrame([("https://E.com/a/",), ("https://e.com/b",)], "url string")
    m = answers.bulk_metrics(urls, spark.createDataFrame([("https://e.com/A", 4)], "target string, backlinks long"), spark.createDataFrame([], "target string, referring_domains long"))
    assert rows(m) == [("https://E.com/a/", 4, None), ("https://e.com/b", None, None)]
    sites = spark.createDataFrame([("sc-domain:A.com", "siteOwner"), ("https://b.com/", "siteOwner"), ("https://www.b.com/", None), ("http://c.com/", "siteUnverifiedUser")], "site_url string, permission string")
    p = spark.createDataFrame([(1, "a.com", ""), (2, "b.com", None), (3, "c.com", None), (4, "d.com", "kept")], "id int, domain string, saved string")
    assert rows(answers.match_property(p, sites)) == [(1, None), (2, "https://www.b.com/"), (3, None), (4, "kept")]
    assert [r[0] for r in sites.select(answers.site_domain(F.col("site_url"))).collect()] == ["a.com", "b.com", "b.com", "c.com"]


def test_listings(spark):
    now = F.lit(dt.datetime(2025, 1, 10))
    p = spark.createDataFrame([(1, "daily", None), (2, "daily", dt.datetime(2025, 1, 9, 1)), (3, "weekly", dt.datetime(2025, 1, 3)), (4, "off", None), (5, "weekly", dt.datetime(2025, 1, 4))], "id int, s string, last timestamp")
    assert rows(listing.due(p, "s", "last", now).select("id")) == [(1,), (3,)]
    g = spark.createDataFrame([(1, 2.0, 5), (2, 1.0, None), (3, 1.0, 9)], "id int, position double, rank int")
    assert [r.id for r in listing.search_listing(g, "position").collect()] == [2, 3, 1] and [r.id for r in listing.search_listing(g, "rank", 2).collect()] == [3, 1]
    assert [r.id for r in listing.ranked_listing(g, "rank").collect()] == [3, 1, 2]
