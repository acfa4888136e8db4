"""Addresses, text and HTML."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions import texts as X
from auditloom.functions import urls as U
from auditloom.functions.html_tree import compile_selector, count_selected, parse
from auditloom.operators import checks
from auditloom.operators.html_facts import analyse, normal_url, page_facts, schema_types

URLS = {
    "HTTPS://Example.COM:443/a//b?utm_source=x&b=2&a=1#f": "https://example.com/a/b?a=1&b=2",
    "http://e.com:80": "http://e.com/", "http://e.com:8080/": "http://e.com:8080/", "https://e.com/A/?print": "https://e.com/A/?print",
    "https://e.com/?b=2&a=1&b=1&&gclid=9": "https://e.com/?a=1&b=2&b=1", "https://www.e.com/x/": "https://www.e.com/x/", "https://e.com/?UTM_Medium=1": "https://e.com/",
}


def test_normalize_url(spark):
    df = spark.createDataFrame([(k,) for k in URLS], "u string").select("u", U.normalize_url(F.col("u")).alias("n"))
    got = {r.u: r.n for r in df.collect()}
    assert got == URLS
    assert {u: normal_url(u) for u in URLS} == URLS


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_keys(spark):
    assert one(spark, "https://www.E.com:81/p/?q#f", U.rank_key) == "E.com:81/p"
    assert one(spark, "www.Shop.e.com", U.project_domain) == "shop.e.com"
    assert one(spark, " HTTP://E.com/P/ ", U.metrics_key) == "http://e.com/p"
    assert one(spark, "https://e.com/?a=1&b=&c=2&a=3&d=4&e=5", U.parameter_count) == 4
    assert one(spark, "https://a.e.com/x", lambda c: U.same_registrable_domain(c, F.lit("e.com"))) is True
    assert one(spark, "https://e.com/blog/x", lambda c: U.segment_of(c, F.lit("https://e.com/"))) == "/blog"
    assert one(spark, "https://e.com", lambda c: U.segment_of(c, F.lit("https://e.com/"))) == "home"


def test_text_functions(spark):
    assert one(spark, "The red fox and red hen", X.phrases) == ["red", "fox", "red", "hen", "red fox", "red hen"]
    assert one(spark, "", X.shingles) == [] and one(spark, "a b", X.shingles) == ["a b"]
    assert one(spark, "a b c d e f", X.shingles) == ["a b c d e", "b c d e f"]
    assert one(spark, "Some    Text", X.content_hash) == one(spark, "some text", X.content_hash)
    assert one(spark, "", X.reading_ease) is None
    assert one(spark, None, X.phrases) == []
    assert one(spark, "table", X.syllables) == 1 and one(spark, "banana", X.syllables) == 3


def test_status_issues(spark):
    kind = "url string, status int, error string, hops array<struct<from:string,to:string,status:int>>"
    df = spark.createDataFrame([
        ("http://e.com/a", 404, None, []), ("https://e.com/b", 200, "boom", None), ("https://e.com/c", None, None, None),
        ("https://e.com/d", 503, "", [("x", "y", 302), ("y", "x", 301), ("x", "y", 301)]),
    ], kind)
    got = {r.url[-1]: [i.code for i in r.i] for r in df.select("url", checks.status_issues(F.col("url"), F.col("status"), F.col("error"), F.col("hops")).alias("i")).collect()}
    assert got == {"a": ["STATUS_404", "NO_HTTPS"], "b": ["FETCH_ERROR"], "c": ["NO_RESPONSE"], "d": ["STATUS_503", "REDIRECT_CHAIN", "TEMP_REDIRECT", "REDIRECT_LOOP"]}


def test_security_and_performance(spark):
    df = spark.createDataFrame([({"Strict-Transport-Security": "x", "Cache-Control": "y"},), ({},), (None,)], "h map<string,string>")
    got = [len(r.s) for r in df.select(checks.security_issues(F.col("h")).alias("s")).collect()]
    assert got == [4, 0, 0]


def test_html_golden():
    html = (
        '<html lang="en"><head><title>A page about testing things</title><meta name="description" content="short"><meta name="viewport" content="width=device-width">'
        '<link rel="canonical" href="/b"></head><body><h1>One</h1><h3>Three</h3><p>x<p>y<img src="http://e.com/i.png"><a href="/z" target="_blank"></a>'
        '<script type="application/ld+json">{bad</script></body></html>'
    )
    f = analyse("https://e.com/a", "https://e.com/a", html, [compile_selector("body > p, a[href^='/z']")])
    assert [i[1] for i in f["issues"]] == [
        "MIXED_CONTENT", "CANONICAL_ELSEWHERE", "META_DESC_TOO_SHORT", "HEADING_HIERARCHY_SKIP", "MISSING_ALT", "MISSING_IMG_DIMENSIONS", "EMPTY_ANCHOR_TEXT", "MISSING_NOOPENER",
        "INVALID_JSON_LD", "MISSING_OG_TITLE", "MISSING_OG_TYPE", "MISSING_OG_URL", "MISSING_OG_IMAGE", "MISSING_TWITTER_CARD", "THIN_CONTENT", "A11Y_IMG_NO_ALT_ATTR",
    ]
    assert f["selected"] == [3] and f["links"] == [{"dst": "https://e.com/z", "internal": True}]


def test_html_stage_survives_odd_input(spark):
    df = spark.createDataFrame([("https://e.com/1", None), ("https://e.com/2", ""), ("https://e.com/3", "<" * 1000 + "<p>\x00</b></p" + "x" * 10), (None, "<title>t</title>")], "url string, html string")
    got = {r.url: r for r in page_facts(df).collect()}
    assert got["https://e.com/1"].html_issues == [] and got["https://e.com/2"].html_issues == []
    assert len(got) == 4 and page_facts(df.limit(0)).count() == 0


def test_selectors():
    root = parse('<div id=a class="x y"><p><b>1</b></p><p data-k="v-1">2</p></div>')
    count = lambda s: count_selected(root, compile_selector(s))
    assert [count(s) for s in ("p", "#a p", ".x > b", "div b", "[data-k|=v]", "*", "p, b")] == [2, 2, 0, 1, 1, 4, 3]
    with pytest.raises(ValueError):
        compile_selector("a >")


def test_schema_types():
    assert schema_types(['{"@type": ["A", "B"], "@graph": [{"@type": "C"}, {"@type": "A"}]}', "bad"]) == ["A", "B", "C"]


def test_crc_of_engine_and_python(spark):
    text = "".join(random.Random(1).choices("abc é", k=50))
    assert one(spark, text, lambda c: F.crc32(F.encode(c, "utf-8"))) == zlib.crc32(text.encode())
    assert np.uint64(1) == 1


def test_text_of_long_pages_is_whole():
    f = analyse("https://e.com/a", "https://e.com/a", f"<p>{'word ' * 9000}</p><p>the last phrase</p>")
    assert f["text"].endswith("the last phrase") and len(f["text"]) == f["char_count"]
