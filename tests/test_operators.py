"""Graph, similarity, scores, rules, external data, sources, sinks and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import duplicates, external, graph, listing, rules, scoring, similarity, sinks
from auditloom.sources import landing
from auditloom.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (3, 4), (9, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "node long")
    assert rows(graph.bfs_depths(edges, 1)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.dead_ends(nodes, edges)) == [(4,), (5,)] and rows(graph.orphans(nodes, edges, 5)) == []
    assert rows(graph.hubs(edges, 1)) == [(3, 2)]
    assert {r.node: (r.links_out, r.links_in) for r in graph.degrees(nodes, edges).collect()}[3] == (2, 1)
    score = {r.node: r.score for r in graph.page_rank(nodes, edges).collect()}
    assert abs(sum(score.values()) - 1) < 1e-9 and score[9] > score[5]
    assert graph.page_rank(nodes.limit(0), edges).count() == 0
    assert rows(graph.linked_groups(spark.createDataFrame([(5, 4), (4, 3), (8, 9)], "a long, b long"))) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_similarity_against_brute_force(spark):
    rng = random.Random(1234)
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        if i % 7 == 6:
            words = docs[i - 1].split()
        elif i % 11 == 10:
            words = docs[i - 1].split()
            words[50] = "changed"
        docs.append(" ".join(words))
    docs += ["", "few words"]
    sets = [{tuple(d.split()[i : i + 5]) for i in range(max(len(d.split()) - 4, 1))} if d else set() for d in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    want = {(j, i) for i, j in want}
    df = spark.createDataFrame(list(enumerate(docs)) + [(99, None)], "k int, t string")
    assert {(r.a, r.b) for r in similarity.exact_pairs(df, "k", "t").collect()} == want
    near = {(r.a, r.b) for r in similarity.near_duplicates(df, "k", "t", way="minhash").collect()}
    assert len(near) >= 0.9 * len(want) and near <= want  # found ones are verified
    assert {(r.a, r.b) for r in similarity.near_duplicates(df, "k", "t").collect()} == want
    s = {r.k: r.minhash for r in similarity.signatures(df, "k", "t").collect()}
    assert s[99] is None and s[60] is None and len(s[61]) == 512 and s[6] == s[5]


def test_scores(spark):
    issues = spark.createDataFrame([(1, "/a", "critical", "NO_HTTPS", "m"), (1, "/a", "info", "ODD", "z"), (1, "/b", "warning", "MISSING_ALT", "x")], "k int, url string, severity string, code string, message string")
    pages = spark.createDataFrame([(1, 2), (2, 0)], "k int, pages long")
    h = {r.k: r for r in scoring.health_scores(pages, issues, "k").collect()}
    assert (h[1].score, h[1].grade, h[2].score, h[2].grade) == (85.0, "B", 0.0, "N/A")
    c = {(r.k, r.category): r.score for r in scoring.category_scores(pages, issues, "k").collect()}
    assert c[1, "security"] == 85.0 and c[1, "technical_seo"] == 82.0 and c[1, "accessibility"] == 92.5 and c[2, "content"] == 100.0
    r = {x.code: x for x in scoring.recommendations(issues, "k").collect()}
    assert (r["NO_HTTPS"].priority_score, r["MISSING_ALT"].estimated_effort, r["ODD"].impact) == (9, "Quick Win", "Low")
    assert r["NO_HTTPS"].recommendation.startswith("Migrate") and r["ODD"].recommendation == "z"
    more = issues.unionByName(spark.createDataFrame([(1, "/a", "warning", "A11Y_COLOR", "m")], issues.schema))
    r = scoring.recommendations(more, "k", spark.createDataFrame([(1, "/o"), (1, "/o"), (1, "/p")], "k int, url string")).collect()
    assert [(x.code, x.priority_score) for x in r] == [("ORPHAN_PAGES", 12), ("NO_HTTPS", 9), ("MISSING_ALT", 4), ("A11Y_COLOR", 2), ("ODD", 2)]
    assert (r[0].severity, r[0].impact, r[0].estimated_effort, r[0].example_urls) == ("warning", "High", "Quick Win", ["/o", "/p"]) and "Accessibility section" in r[3].recommendation
    assert scoring.recommendations(issues.limit(0), "k").count() == 0


def test_duplicates(spark):
    p = spark.createDataFrame([(1, "/a", "T"), (1, "/b", "T"), (1, "/c", ""), (1, "/d", ""), (2, "/a", "T"), (1, None, None)], "k int, url string, title string")
    assert [(r.url, r.pages) for r in duplicates.duplicate_groups(p, "k", ["title"]).orderBy("url").collect()] == [("/a", 2), ("/b", 2)]
    h = spark.createDataFrame([("/a", "x")], "url string, content_hash string")
    assert rows(duplicates.fold_duplicates(h, spark.createDataFrame([("/b", "/a"), ("/c", "/q")], "url string, owner string"))) == [("/a", "x"), ("/b", "x")]


def test_rules(spark):
    check = lambda **k: {"id": 1, "name": "n", "severity": "info", "check": k}
    assert rules.validate(check(type="field", field="title", op="length_gte", value="5")) == []
    assert rules.validate(check(type="field", field="title", op="gte", value="5")) and rules.validate(check(type="selector", selector="a >", op="exists"))
    df = spark.createDataFrame([("https://e.com/blog/x", " Hello ", 10, None, "<p>", [2])], "url string, title string, word_count int, status int, html string, selected array<int>")
    table = [
        (dict(type="field", field="title", op="equals", value="hello"), False), (dict(type="field", field="title", op="equals", value="Hello"), True),
        (dict(type="field", field="title", op="starts_with", value="HE"), True), (dict(type="field", field="title", op="length_lte", value="5"), True),
        (dict(type="field", field="status", op="eq", value="0"), True), (dict(type="selector", selector="p", op="count_gte", value="2"), True), (dict(type="text", scope="html", op="not_contains", value="<P>"), False),
    ]
    made = [{"id": i, "name": "n", "severity": "info", "check": c} for i, (c, _) in enumerate(table)]
    got = {r.rule_id: r.passed for r in rules.evaluate(df, made).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(table)}
    scoped = [dict(made[0], url_pattern="/shop*"), dict(made[1], url_pattern="/b?og/[!y]")]
    assert [r.rule_id for r in rules.evaluate(df, scoped).collect()] == [1]
    assert rules.rules_digest(made) != rules.rules_digest(made[:1]) and rules.rules_digest([made[4]]) == ""


def test_ranks(spark):
    kind = "id long, keyword_id int, status string, position int"
    c = spark.createDataFrame([(1, 1, "ranked", 5), (2, 1, "skipped", None), (3, 1, "ranked", 12), (4, 1, "not_ranked", None), (5, 2, "ranked", 3)], kind)
    assert rows(external.rank_overview(c)) == [(1, None, 12, None), (2, 3, None, None)]
    assert {(r.id, r.kind) for r in external.rank_alerts(c).collect()} == {(3, "drop"), (3, "left_top10"), (4, "lost")}
    table = [(4, 9, {}, {"drop"}), (4, 6, {}, set()), (4, 6, {"drop_threshold": 2}, {"drop"}), (8, 12, {}, {"drop", "left_top10"}), (8, 12, {"top10": False}, {"drop"}),
             (5, None, {}, {"lost", "left_top10"}), (9, 3, {}, set()), (9, 3, {"gain_threshold": 5}, {"gain"}), (None, 3, {}, set())]
    for options in ({}, {"drop_threshold": 2}, {"top10": False}, {"gain_threshold": 5}):
        mine = [(i, old, new, kinds) for i, (old, new, o, kinds) in enumerate(table) if o == options]
        got = external.rank_alerts(spark.createDataFrame([x for i, old, new, _ in mine for x in ((2 * i, i, "ranked", old), (2 * i + 1, i, "ranked", new))], kind), **options).collect()
        assert {(r.keyword_id, r.kind) for r in got} == {(i, k) for i, _, _, kinds in mine for k in kinds}
    serp = spark.createDataFrame([("k", 1, "u1", "blog.me.com"), ("k", 2, "u2", "me.com"), ("k", 3, "u3", "notme.com")], "keyword string, position int, url string, domain string")
    assert rows(external.result_positions(serp, spark.createDataFrame([("me", "me.com")], "owner string, domain string"))) == [("k", "me", 1, "u1")]


def test_gaps(spark):
    r = spark.createDataFrame([("me", "a", 50, 1, 1), ("r1", "a", 1, 9, 9), ("r1", "b", 3, None, 40), ("r2", "b", 2, 100, 10), ("r2", "c", 30, 5, 5)], "domain string, keyword string, position int, search_volume int, difficulty int")
    g = external.content_gap(r, "me", ["r1", "r2"]).collect()
    assert [(x.keyword, x.positions, x.search_volume, x.difficulty, x.opportunity) for x in g] == [("b", {"r1": 3, "r2": 2}, 100, 40, 60.0)]
    links = spark.createDataFrame([("s", "r1"), ("s", "r1"), ("s", "r2"), ("t", "r1"), ("t", "me")], "source string, target string")
    assert [(x.source, x.rivals, x.linked) for x in external.link_gap(links, "me", ["r1", "r2"]).collect()] == [("s", 2, {"r1": 2, "r2": 1})]


def test_search_and_backlinks(spark):
    daily = spark.createDataFrame([(1, dt.date(2025, 1, i), float(i), 10.0, 1.0 * i) for i in range(1, 6)] + [(2, dt.date(2025, 1, 1), 0.0, 0.0, 1.0)], "p int, date date, clicks double, impressions double, position double")
    k = {(r.p, r.period): r for r in external.period_kpis(daily, "p", 2).collect()}
    assert k[1, "current"].clicks == 9 and k[1, "previous"].position == 2.5 and k[2, "current"].ctr is None
    pages = spark.createDataFrame([("https://e.com/a", 404)], "url string, status int")
    links = spark.createDataFrame([("https://x.com/1", "https://E.com/a#q"), ("https://x.com/2", "https://e.com/a")], "url_from string, url_to string")
    assert rows(external.broken_backlinks(links, pages)) == [("https://e.com/a", 404, 2, 1)]
    assert external.backlink_issues(links, pages).first().message == "2 backlinks from 1 domain point to this broken page. Redirect it to keep their value."


def test_brands(spark):
    a = spark.createDataFrame([(1, "Try Acme-Pro, then acme. Beta!"), (2, "nothing"), (3, None)], "answer_id int, text string")
    b = spark.createDataFrame([("me", 0, ["Acme", "Acme-Pro"]), ("rival", 1, ["beta"]), ("none", 2, [])], "owner string, ord int, terms array<string>")
    m = external.brand_mentions(a, b)
    assert rows(m) == [(1, "me", 5, 2, 1), (1, "rival", 26, 1, 2)]
    assert rows(external.share_of_voice(m)) == [("me", 1, 0.5), ("rival", 1, 0.5)]
    text = "Books to Scrape (books.demo.com) beats Amazon."
    own = spark.createDataFrame([("books.demo.com", 0, ["Books to Scrape"], "books.demo.com"), ("amazon.com", 1, ["Amazon"], "amazon.com")], "owner string, ord int, terms array<string>, domain string")
    one = spark.createDataFrame([(7, text), (8, "")], "answer_id int, text string")
    assert [(text[r.start : r.stop], r.owner) for r in external.highlights(one, own).orderBy("n").collect()] == [("Books to Scrape", "books.demo.com"), ("books.demo.com", "books.demo.com"), ("Amazon", "amazon.com")]
    assert [(r.owner, r.rank, r.mentions) for r in external.brand_mentions(one, own).collect()] == [("books.demo.com", 1, 2), ("amazon.com", 2, 1)]


def test_citations(spark):
    r = "https://vertexaisearch.cloud.google.com/grounding-api-redirect/abc"
    c = spark.createDataFrame([(1, 0, "https://reviews.example.com/a", None), (1, 1, "https://shop.books.demo.com/b", ""), (1, 2, r, "Books.demo.com "), (1, 3, "https://reviews.example.com/c", None),
                               (1, 4, r, "A great page"), (1, 5, "https://x.googleusercontent.com/q", "no domain"), (2, 0, "https://notbooks.demo.com.evil.io/", None), (2, 1, "https://www.amazon.com/x", None), (2, 2, None, None)],
                              "answer_id int, ord int, url string, title string")
    assert [(x.answer_id, x.domain) for x in external.answer_citations(c).orderBy("answer_id", "ord").collect()] == [(1, "reviews.example.com"), (1, "shop.books.demo.com"), (1, "books.demo.com"), (2, "notbooks.demo.com.evil.io"), (2, "amazon.com")]
    assert rows(external.own_citation(c, "books.demo.com")) == [(1, True), (2, False)]
    assert {x.domain for x in external.cited_domains(c).collect()} == {"reviews.example.com", "shop.books.demo.com", "books.demo.com", "notbooks.demo.com.evil.io", "amazon.com"}


def test_content_summary(spark):
    p = spark.createDataFrame([("a", 100, None, ["Page"], ["Rare book prices", "Buying rare books"]), ("b", None, 3, ["Other"], ["Unfetched words"])], "url string, word_count int, ref_domains int, schema_types array<string>, h2 array<string>")
    got = external.content_summary(p, "rare books")
    assert rows(got["terms"]) == [("buying", 1), ("prices", 1)] and rows(got["types"]) == [("Page", 1)] and got["medians"].first()[:2] == (100, 3)


def test_vitals_render_accessibility(spark):
    v = spark.createDataFrame([("a", "field", 2600.0, 100.0, 0.3, 900.0), ("b", "lab", 100.0, 999.0, 0.0, 100.0), ("c", "lab", None, None, None, None)], "url string, data_kind string, lcp double, inp double, cls double, tbt double")
    got = {r.url: (r.rating, [i.code for i in r.issues]) for r in external.vitals_ratings(v).collect()}
    assert got == {"a": ("poor", ["CWV_LCP_NEEDS_IMPROVEMENT", "CWV_CLS_POOR"]), "b": ("good", []), "c": (None, [])}
    kind = "url string, title string, meta_description string, h1 string, canonical string, meta_robots string, word_count int, links array<string>"
    raw = spark.createDataFrame([("u", "A", None, None, None, None, 100, ["x"])], kind)
    rendered = spark.createDataFrame([("u", "B", "", None, None, None, 400, ["x", "y"])], kind)
    r = external.render_comparison(raw, rendered).first()
    assert [i.code for i in r.issues] == ["JS_CONTENT_DEPENDENT", "JS_TITLE_CHANGED", "JS_ONLY_LINKS"] and r.js_only_links == ["y"]
    assert [i.message for i in r.issues] == ["100 words in raw HTML, 400 after JavaScript", "Title changed by JavaScript: 'A' → 'B'", "1 internal link appears only after JavaScript"]
    raw = spark.createDataFrame([("u", "Shop ", None, "x", None, None, None, [])], kind)
    rendered = spark.createDataFrame([("u", "Shop", " ", None, None, None, 200, [f"/{i:03}" for i in range(60)])], kind)
    r = external.render_comparison(raw, rendered).first()
    assert [i.code for i in r.issues] == ["JS_CONTENT_DEPENDENT", "JS_H1_CHANGED", "JS_ONLY_LINKS"] and list(r.changes) == ["h1"] and (len(r.js_only_links), r.js_only_links_count) == (50, 60)
    assert r.issues[1].message == "H1 changed by JavaScript: 'x' → (none)" and r.issues[2].message.startswith("60 internal links appear")
    x = spark.createDataFrame([("u", [("color-contrast", "serious", 2), ("label", "critical", 1)])], "url string, violations array<struct<id:string,impact:string,nodes_count:int>>")
    s = external.accessibility_summary(x).first()
    assert s.score == 83 and [i.code for i in s.issues] == ["A11Y_COLOR_CONTRAST"]
    x = spark.createDataFrame([("u", [("button-name", "evil", 1, "h" * 400), ("b", "serious", 2, None)]), ("v", []), ("w", None)], "url string, violations array<struct<id:string,impact:string,nodes_count:int,help:string>>")
    s = {q.url: q for q in external.accessibility_summary(x).collect()}
    assert s["u"].score == 92 and s["u"].counts == {"critical": 0, "serious": 1, "moderate": 0, "minor": 1} and (s["v"].score, s["w"].score) == (100, 100)
    assert [(i.severity, i.message[:3], i.message[-21:]) for i in s["u"].issues] == [("warning", "b (", "b (2 elements, serious)"[-21:]), ("info", "hhh", "hh (1 element, minor)")]
    assert external.vitals_ratings(v).where("url = 'a'").first().issues[0].message == "LCP 2.6 s (field) — needs improvement, over 2.5 s"
    i = spark.createDataFrame([("u", "FAIL", "Crawled", "https://e.com/a", "https://e.com/b", None), ("v", "NEUTRAL", None, "", "x", "noindex"), ("w", "PASS", "", "https://e.com/a#x", "https://E.com/a", "")], "url string, verdict string, coverage string, google_canonical string, user_canonical string, robots string")
    assert [(q.url, q.code, q.message) for q in external.index_issues(i).collect()] == [("u", "GSC_NOT_INDEXED", "Not indexed by Google: Crawled"), ("u", "GSC_CANONICAL_MISMATCH", "Google chose https://e.com/a over your canonical https://e.com/b")]


def test_listing(spark):
    p = spark.createDataFrame([("/B", 1), ("/b2", 0), ("/c", 3)], "url string, issue_count int")
    page, total = listing.list_pages(p, text="/b", sort="issue_count", descending=True)
    assert [r.url for r in page.collect()] == ["/B", "/b2"] and total.first().total == 2
    with pytest.raises(ValueError):
        listing.list_pages(p, sort="1; drop")


def test_landing(spark):
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=iso-8859-1"), (bytearray(b'<meta charset="windows-1251">\xef'), "text/html"), (None, None), (bytearray("é".encode()), None)], "body binary, content_type string")
    assert [r.html for r in landing.decode_bodies(df).collect()] == ["é", '<meta charset="windows-1251">п', None, "é"]
    robots = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /x\nCrawl-delay: 2\nSitemap: https://e.com/s.xml")], "host string, text string")
    urls = spark.createDataFrame([("https://e.com/x/1",), ("https://e.com/y",), ("https://f.com/x",)], "url string")
    assert rows(landing.robots_allowed(urls, robots)) == [("https://e.com/x/1", False), ("https://e.com/y", True), ("https://f.com/x", True)]
    f = landing.robots_facts(robots).first()
    assert f.sitemaps == ["https://e.com/s.xml"] and f.crawl_delay == 2.0
    maps = spark.createDataFrame([("s", '<urlset xmlns="x"><url><loc> https://e.com/?a=1&amp;b=2 </loc></url></urlset>')], "sitemap string, xml string")
    assert rows(landing.sitemap_entries(maps)) == [("s", "https://e.com/?a=1&b=2", False)]
    h = spark.createDataFrame([({"ETag": "1", "X": "a"}, {"etag": "2"})], "s map<string,string>, f map<string,string>")
    assert h.select(landing.merge_headers(F.col("s"), F.col("f")).alias("m")).first().m == {"x": "a", "etag": "2"}
    j = spark.createDataFrame([("k", '{"items":[{"type":"organic","rank_group":1,"url":"https://www.a.com/p","title":"t"},{"type":"paid","rank_group":2}]}')], "keyword string, json string")
    assert rows(landing.serp_items(j)) == [("k", 1, "https://www.a.com/p", "a.com", "t")]
    ps = spark.createDataFrame([("u", '{"lighthouseResult":{"audits":{"largest-contentful-paint":{"numericValue":900}}},"loadingExperience":{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":12}}}}')], "url string, json string")
    r = landing.page_speed(ps).first()
    assert (r.data_kind, r.lcp, r.cls) == ("field", 900.0, 0.12)


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "audit_id int, v string")
    sinks.write_audit(a, str(tmp_path / "t"))
    sinks.write_audit(spark.createDataFrame([(2, "z")], "audit_id int, v string"), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("audit_id", "v")) == [(1, "x"), (2, "z")]
    assert rows(sinks.upsert(a, spark.createDataFrame([(2, "n"), (3, "m")], "audit_id int, v string"), ["audit_id"])) == [(1, "x"), (2, "n"), (3, "m")]
    sinks.export_csv(a.withColumn("l", F.array(F.lit(1))), str(tmp_path / "csv"), note="dry run")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["note", "audit_id", "v", "l"]
    sinks.export_html(a, str(tmp_path / "r.html"), "<t>")
    assert "&lt;t&gt;" in (tmp_path / "r.html").read_text()


def fed(pace, n, ms=100.0, failed=False):
    for _ in range(n):
        pace.record(ms, failed)
    return pace.limit


def test_host_pace():
    """Growth after healthy windows, halving at failures and slow windows, spared failures, waits, dumps."""
    p = events.HostPace(32, most=64)
    assert fed(p, 50) == 32 and fed(p, 50) == 36 and fed(p, 50) == 40
    assert fed(events.HostPace(32, most=34, window=10), 100) == 34 and fed(events.HostPace(8, most=8, window=10), 100) == 8
    p = events.HostPace(32)
    assert fed(p, 20, failed=True) == 16 and fed(p, 16) == 16 and p.record(100.0, True) == 8
    p = events.HostPace(8)
    for _ in range(10):
        p.record(100.0, True)
        fed(p, p.limit)
    assert p.limit == 4
    for slow, want in ((250.0, 16), (180.0, 32)):
        p = events.HostPace(32, window=10)
        fed(p, 10)
        assert fed(events.HostPace.load(p.dump(), window=10), 10, slow) == want
    assert fed(events.HostPace(32, window=10), 20, None) == 36
    p = events.HostPace(32, window=10)
    p.record(100.0, True)
    assert fed(p, 10) == 16 and p.record(1.0, True) == 16 and fed(p, 9) == 16 and fed(p, 10) == 20  # a spared failure spoils its window
    p.record(None, True, 5.0, 100.0)
    assert p.wait_until == 105.0 and p.record(None, True, 600.0, 200.0) and p.wait_until == 260.0


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows_ = [("s", i, "page_crawled", f"/{i}", "h", t + dt.timedelta(seconds=i), 100.0, False, None) for i in range(60)]
    spark.createDataFrame(rows_, events.EVENTS).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    q = events.adaptive_limits(stream).writeStream.format("memory").queryName("limits").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(answers), max(limit) from limits").first()[0] == 60
    batch = spark.read.parquet(str(tmp_path / "in"))
    p = events.progress(batch, 120).first()
    assert p.pages == 60 and p.percent == 50.0
    sent = []
    alerts = [(1, "drop", "mail"), (1, "drop", "mail"), (2, "lost", "mail")]
    kind = "rank_check_id int, kind string, channel string"
    spark.createDataFrame(alerts, kind).write.parquet(str(tmp_path / "alerts"))
    for n in range(2):
        s = spark.readStream.schema(kind).parquet(str(tmp_path / "alerts"))
        events.deliver_alerts(s, str(tmp_path / "sent"), str(tmp_path / f"cp{n}"), lambda df: sent.extend(df.collect())).awaitTermination(120)
    assert len(sent) == 2
