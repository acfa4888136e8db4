"""Queries of the remaining operators: the whole audit, landed answers, listings, histories, writing, with their SQL.

Landed JSON is made from the tables and parsed again, so the SQL reads the tables directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import audit, checks, duplicates, external, graph, history, listing, sinks
from auditloom.plans.audit_queries import _E, _ISSUES, _edges, _nodes, _normal, _part, issues_once, pages_once, recommendations_sql
from auditloom.plans.external_queries import _CHECKS, _checks
from auditloom.sources import answers, landing
from auditloom.sources.tables import table
from auditloom.streaming import events as streams

Q: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of session and folder under a name."""
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# ---------------------------------------------------------------- the whole audit

HOP = "array<struct<from:string,to:string,status:int>>"


def _responses(spark, d):
    """Every distinct page record as a response; its key stands for the url, headers depend on it, and there is no html."""
    p = pages_once(spark, d)
    made = F.when(F.col("page_id") % 3 == 0, F.expr("map('X-Frame-Options', 'DENY', 'Content-Encoding', 'gzip', 'Referrer-Policy', 'origin')")).when(F.col("page_id") % 3 == 1, F.expr("map('Cache-Control', 'no-store')"))
    ms = F.when((F.col("response_time_ms") >= 0) & ~F.isnan("response_time_ms"), F.floor("response_time_ms"))
    return p.select(
        F.col("url"), "page_id", "final_url", "status", "error", made.alias("headers"), ms.alias("response_time_ms"), F.lit(None).cast(HOP).alias("redirect_chain"),
        F.col("meta_robots").alias("robots_directives"), *[F.lit(None).cast("int").alias(c) for c in ("dom_nodes", "blocking_css", "blocking_js", "html_bytes")],
    ).where("url is not null")


_RESPONSE_SQL = f"""p AS (SELECT DISTINCT * FROM pages), x AS (SELECT *, lower(coalesce(meta_robots, '')) AS rb, CASE WHEN response_time_ms >= 0 AND NOT isnan(response_time_ms) THEN floor(response_time_ms)::BIGINT END AS ms,
  {_part('url', 3)} AS path, len(list_distinct(list_transform(list_filter(string_split({_part('url', 4)}, '&'), lambda y: regexp_full_match(y, '[^=]*=[\\s\\S]+')), lambda y: split_part(y, '=', 1)))) AS params FROM p WHERE url IS NOT NULL),
ri AS (SELECT url, 'critical' AS severity, 'FETCH_ERROR' AS code, 'Failed to fetch: ' || error AS message FROM x WHERE coalesce(error, '') <> ''
UNION ALL SELECT url, 'critical', 'NO_RESPONSE', 'No response received' FROM x WHERE coalesce(error, '') = '' AND status IS NULL
UNION ALL SELECT url, 'critical', 'STATUS_404', 'Page returns 404 Not Found' FROM x WHERE coalesce(error, '') = '' AND status = 404
UNION ALL SELECT url, 'warning', 'STATUS_410', 'Page returns 410 Gone' FROM x WHERE coalesce(error, '') = '' AND status = 410
UNION ALL SELECT url, 'critical', 'STATUS_' || status, 'Server error ' || status FROM x WHERE coalesce(error, '') = '' AND status >= 500
UNION ALL SELECT url, 'info', 'STATUS_' || status, 'Page redirects (' || status || ')' FROM x WHERE coalesce(error, '') = '' AND status IN (301, 302, 307, 308)
UNION ALL SELECT url, 'critical', 'NO_HTTPS', 'Page is served over HTTP, not HTTPS' FROM x WHERE coalesce(error, '') = '' AND lower({_part('url', 1)}) <> 'https'
UNION ALL SELECT url, 'warning', 'NOINDEX', 'Page is set to noindex' FROM x WHERE contains(rb, 'noindex')
UNION ALL SELECT url, 'info', 'NOFOLLOW', 'Page is set to nofollow' FROM x WHERE contains(rb, 'nofollow')
UNION ALL SELECT url, 'info', 'URL_UPPERCASE', 'URL path contains uppercase characters' FROM x WHERE regexp_matches(path, '\\p{{Lu}}')
UNION ALL SELECT url, 'info', 'URL_UNDERSCORE', 'URL uses underscores instead of hyphens' FROM x WHERE contains(path, '_')
UNION ALL SELECT url, 'info', 'URL_TOO_LONG', 'URL is long (' || length(url) || ' chars)' FROM x WHERE length(url) > 115
UNION ALL SELECT url, 'info', 'TOO_MANY_PARAMS', 'URL has ' || params || ' query parameters' FROM x WHERE params > 3
UNION ALL SELECT url, 'warning', 'MISSING_HEADER_STRICT_TRANSPORT_SECURITY', 'Missing security header: strict-transport-security' FROM x WHERE page_id % 3 <> 2
UNION ALL SELECT url, 'info', 'MISSING_HEADER_CONTENT_SECURITY_POLICY', 'Missing security header: content-security-policy' FROM x WHERE page_id % 3 <> 2
UNION ALL SELECT url, 'info', 'MISSING_HEADER_X_CONTENT_TYPE_OPTIONS', 'Missing security header: x-content-type-options' FROM x WHERE page_id % 3 <> 2
UNION ALL SELECT url, 'info', 'MISSING_HEADER_X_FRAME_OPTIONS', 'Missing security header: x-frame-options' FROM x WHERE page_id % 3 = 1
UNION ALL SELECT url, 'info', 'MISSING_HEADER_REFERRER_POLICY', 'Missing security header: referrer-policy' FROM x WHERE page_id % 3 = 1
UNION ALL SELECT url, 'warning', 'SLOW_TTFB', 'Slow response time: ' || ms || 'ms' FROM x WHERE ms > 800
UNION ALL SELECT url, 'info', 'NO_COMPRESSION', 'Response is not compressed (no Content-Encoding header)' FROM x WHERE page_id % 3 <> 0
UNION ALL SELECT url, 'info', 'NO_CACHE_HEADER', 'No Cache-Control header set' FROM x WHERE page_id % 3 <> 1)"""


@query("response_checks", f"WITH {_RESPONSE_SQL} SELECT * FROM ri")
def response_checks(spark, d):
    return audit.response_issues(_responses(spark, d))


def _broken_targets(spark, d):
    p = table(spark, d, "pages")
    links = p.where("canonical is not null and url is not null").select(F.col("url").alias("url_from"), F.col("canonical").alias("url_to"))
    return links, p.where("status >= 400").groupBy("url").agg(F.max("status").alias("status"))


_BACKLINK_SQL = f"""bl AS (SELECT {_normal('canonical')} AS k, regexp_replace(regexp_replace(lower(regexp_extract(trim(url, ' '), '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?', 2)), '^.*@', ''), ':\\d*$', '') AS host FROM pages WHERE canonical IS NOT NULL AND url IS NOT NULL),
bh AS (SELECT k, count(*) AS n, count(DISTINCT host) AS h FROM bl GROUP BY k), bb AS (SELECT DISTINCT url FROM pages WHERE status >= 400),
bi AS (SELECT url, 'warning' AS severity, 'BACKLINK_TO_BROKEN_PAGE' AS code, n || ' backlink' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' from ' || h || ' domain' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' point to this broken page. Redirect it to keep their value.' AS message
  FROM bb JOIN bh ON bh.k = {_normal('bb.url')})"""


@query("backlink_issues", f"WITH {_BACKLINK_SQL} SELECT * FROM bi")
def backlink_issues(spark, d):
    return external.backlink_issues(*_broken_targets(spark, d))


def _inspected(spark, d):
    p = pages_once(spark, d).where("url is not null")
    return p.select(
        "url", F.when(F.col("page_id") % 5 == 0, "FAIL").when(F.col("page_id") % 5 == 1, "NEUTRAL").otherwise("PASS").alias("verdict"), F.when(F.col("page_id") % 2 == 0, "Crawled").alias("coverage"),
        F.col("canonical").alias("google_canonical"), F.col("final_url").alias("user_canonical"), F.col("meta_robots").alias("robots"),
    )


_INDEX_SQL = f"""xi AS (SELECT url, 'warning' AS severity, 'GSC_NOT_INDEXED' AS code, 'Not indexed by Google: ' || CASE WHEN page_id % 2 = 0 THEN 'Crawled' WHEN page_id % 5 = 0 THEN 'FAIL' ELSE 'NEUTRAL' END AS message
  FROM (SELECT DISTINCT * FROM pages) WHERE url IS NOT NULL AND page_id % 5 <= 1 AND NOT contains(lower(coalesce(meta_robots, '')), 'noindex')
UNION ALL SELECT url, 'info', 'GSC_CANONICAL_MISMATCH', 'Google chose ' || canonical || ' over your canonical ' || final_url FROM (SELECT DISTINCT * FROM pages) WHERE url IS NOT NULL AND canonical <> '' AND final_url <> '' AND {_normal('canonical')} <> {_normal('final_url')})"""


@query("index_issues", f"WITH {_INDEX_SQL} SELECT * FROM xi")
def index_issues(spark, d):
    return external.index_issues(_inspected(spark, d))


def _every_issue(spark, d):
    return audit.all_issues({"response": response_checks(spark, d), "backlinks": backlink_issues(spark, d), "index": index_issues(spark, d)}).withColumn("audit_id", F.lit(1))


_EVERY_SQL = f"{_RESPONSE_SQL}, {_BACKLINK_SQL}, {_INDEX_SQL}, ai AS (SELECT 1 AS audit_id, *, 'response' AS source FROM ri UNION ALL SELECT 1, *, 'backlinks' FROM bi UNION ALL SELECT 1, *, 'index' FROM xi)"


@query("full_audit_issues", f"WITH {_EVERY_SQL} SELECT * FROM ai")
def full_audit_issues(spark, d):
    """The issues of all sources of one audit together."""
    return _every_issue(spark, d)


@query("full_audit_recommendations", f"WITH {_EVERY_SQL}, o AS (SELECT audit_id, url, severity, code, message FROM ai UNION ALL SELECT DISTINCT 1, url, 'warning', 'ORPHAN_PAGES', 'Add internal links to orphan pages so crawlers and users can discover them.' FROM pages WHERE found_via = 'sitemap' AND url IS NOT NULL), {recommendations_sql('o', 'audit_id')}")
def full_audit_recommendations(spark, d):
    """Advice over the issues of all sources; pages found only in a sitemap stand in for orphans."""
    from auditloom.operators import scoring

    orphans = table(spark, d, "pages").where("found_via = 'sitemap' and url is not null").select(F.lit(1).alias("audit_id"), "url").distinct()
    return scoring.recommendations(_every_issue(spark, d), "audit_id", orphans).withColumn("example_urls", F.array_join("example_urls", " "))


@query("full_audit_html")
def full_audit_html(spark, d):
    """The whole audit of all cached pages with their html: every issue found. Tested against fixtures."""
    from auditloom.plans.audit_queries import RULES, _cached_html

    status = table(spark, d, "pages").groupBy("url").agg(F.max("status").alias("status"))
    nothing = {"error": "string", "headers": "map<string,string>", "response_time_ms": "double", "redirect_chain": HOP, "depth": "int", "alias_of": "string", "duplicate_of": "string"}
    responses = _cached_html(spark, d).join(status, "url", "left").select("url", F.col("url").alias("final_url"), "status", "html", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    return audit.full_audit(responses, RULES)["issues"].drop("audit_id")


_HTML = "h AS (SELECT url, json_extract_string(j, '$.html') AS html FROM (SELECT url, CASE WHEN json_valid(t) THEN t END AS j FROM (SELECT url, arg_max(coalesce(try_cast(decode(html_blob) AS VARCHAR), ''), analysed_at) AS t FROM page_cache GROUP BY url)) WHERE j IS NOT NULL)"


@query("html_counts", f"""WITH {_HTML}, c AS (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<noscript>.*?</noscript>', '', 'g') AS t, html FROM h)
SELECT url, len(regexp_extract_all(html, '<h2[ >]'))::INT AS h2_count, len(regexp_extract_all(html, '<h3[ >]'))::INT AS h3_count, len(regexp_extract_all(html, '<img[ >/]'))::INT AS images_count,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&', 'g'), '&quot;', '"', 'g'), '&#x27;', '''', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g')) AS title, nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS lang FROM c""")
def html_counts(spark, d):
    """Facts of the parsed pages that regular expressions can count."""
    from auditloom.operators.html_facts import page_facts
    from auditloom.plans.audit_queries import _cached_html

    return page_facts(_cached_html(spark, d)).select("url", "h2_count", "h3_count", "images_count", "title", "lang")


# ---------------------------------------------------------------- landed answers

def _json(df, *keep, **items):
    """Rows gathered by ``keep`` into the JSON of one answer each."""
    return df.groupBy(*keep).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in items.items()])).alias("items")).select(*keep, F.to_json(F.array(F.struct("items"))).alias("json"))


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("string").alias("target"), F.col("s_name").alias("name"))


@query("answers_referring_domains", "SELECT s_nationkey::VARCHAR AS target, s_name AS domain, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::BIGINT END AS rank, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey * 10 END::BIGINT AS backlinks FROM supplier WHERE s_suppkey % 7 <> 0")
def answers_referring_domains(spark, d):
    s = _suppliers(spark, d)
    made = _json(s, "target", domain=F.when(F.col("k") % 7 != 0, F.col("name")), rank=F.when(F.col("k") % 3 != 0, F.col("k")), backlinks=F.when(F.col("k") % 4 != 0, F.col("k") * 10), first_seen=F.lit("2025-01-01"))
    return answers.referring_domains(made).select("target", "domain", "rank", "backlinks")


@query("answers_backlinks", f"""WITH b AS (SELECT s_nationkey::VARCHAR AS target, 'https://f.example/' || s_suppkey AS url_from, 'https://t.example/' || s_suppkey % 9 AS url_to, s_suppkey % 2 = 0 AS dofollow, CASE WHEN s_suppkey % 5 = 0 THEN 404 END AS target_status FROM supplier WHERE s_suppkey % 6 <> 0),
p AS (SELECT DISTINCT 'https://t.example/' || s_suppkey % 9 AS url, (200 + s_suppkey % 9)::INT AS status FROM supplier) SELECT b.*, 'broken' AS kind, '' AS anchor, p.status AS crawled_status FROM b LEFT JOIN p ON p.url = b.url_to AND p.status < 207""")
def answers_backlinks(spark, d):
    s = _suppliers(spark, d)
    to = F.concat(F.lit("https://t.example/"), (F.col("k") % 9).cast("string"))
    made = _json(s, "target", url_from=F.when(F.col("k") % 6 != 0, F.concat(F.lit("https://f.example/"), F.col("k").cast("string"))), url_to=to, dofollow=F.when(F.col("k") % 2 == 0, True), url_to_status_code=F.when(F.col("k") % 5 == 0, 404))
    pages = s.select(to.alias("url"), F.when(F.col("k") % 9 < 7, (200 + F.col("k") % 9)).cast("int").alias("status")).distinct()
    links = answers.backlinks(made.withColumn("kind", F.lit("broken"))).drop("domain_from_rank", "first_seen", "last_seen")
    return listing.broken_link_statuses(links, pages)


@query("answers_backlink_history", "SELECT o_custkey::VARCHAR AS target, epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) AS month_us, o_orderkey::BIGINT AS backlinks, 0::BIGINT AS referring_domains FROM orders")
def answers_backlink_history(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("target"), F.col("o_orderdate"), F.col("o_orderkey").alias("k"))
    made = _json(o, "target", date=F.date_format("o_orderdate", "yyyy-MM-dd"), backlinks=F.col("k"))
    return answers.backlink_history(made).select("target", F.unix_micros(F.col("month").cast("timestamp")).alias("month_us"), "backlinks", "referring_domains")


@query("answers_search_rows", "SELECT s_nationkey::VARCHAR AS site, s_name AS key, s_suppkey::DOUBLE AS clicks, 0.0::DOUBLE AS ctr FROM supplier")
def answers_search_rows(spark, d):
    s = _suppliers(spark, d)
    made = s.groupBy(F.col("target").alias("site")).agg(F.collect_list(F.struct(F.array("name").alias("keys"), F.col("k").cast("double").alias("clicks"))).alias("rows")).select("site", F.to_json(F.struct("rows")).alias("json"))
    return answers.search_rows(made).select("site", F.col("keys")[0].alias("key"), "clicks", "ctr")


@query("answers_inspections", "SELECT url, CASE WHEN page_id % 5 = 0 THEN 'FAIL' WHEN page_id % 5 = 1 THEN 'NEUTRAL' ELSE 'PASS' END AS verdict, canonical AS google_canonical, final_url AS user_canonical FROM (SELECT DISTINCT * FROM pages) WHERE url IS NOT NULL")
def answers_inspections(spark, d):
    i = _inspected(spark, d)
    state = F.struct("verdict", F.col("google_canonical").alias("googleCanonical"), F.col("user_canonical").alias("userCanonical"))
    made = i.select("url", F.to_json(F.struct(F.struct(state.alias("indexStatusResult")).alias("inspectionResult"))).alias("json"))
    return answers.inspections(made).select("url", "verdict", "google_canonical", "user_canonical")


@query("answers_ranked_keywords", "SELECT l_suppkey::VARCHAR AS domain, lower(p_name) AS keyword, l_quantity::INT AS position, '' AS url, CASE WHEN p_size % 2 = 0 THEN p_size END AS search_volume, p_size AS difficulty FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity::INT > 0")
def answers_ranked_keywords(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    size = F.col("p_size")
    info = F.struct(F.upper("p_name").alias("keyword"), F.struct(F.when(size % 2 == 0, size).alias("search_volume")).alias("keyword_info"), F.struct(size.alias("keyword_difficulty")).alias("keyword_properties"))
    made = _json(l.withColumn("domain", F.col("l_suppkey").cast("string")), "domain", keyword_data=info, ranked_serp_element=F.struct(F.struct(F.col("l_quantity").cast("int").alias("rank_group")).alias("serp_item")))
    return answers.ranked_keywords(made)


@query("answers_difficulty", "SELECT lower(p_name) AS keyword, max(p_size) AS difficulty FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def answers_difficulty(spark, d):
    p = table(spark, d, "part")
    return answers.keyword_difficulty(_json(p, "p_brand", keyword=F.col("p_name"), keyword_difficulty=F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).drop("p_brand"))


@query("answers_serp", "SELECT l_orderkey::VARCHAR AS keyword, l_linenumber::INT AS position, 'https://www.s' || l_suppkey || '.example/p' AS url, 's' || l_suppkey || '.example' AS domain, 't' AS title FROM lineitem WHERE l_linenumber <> 2")
def answers_serp(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    item = F.struct(F.when(F.col("l_linenumber") == 2, "paid").otherwise("organic").alias("type"), F.col("l_linenumber").cast("int").alias("rank_group"), F.concat(F.lit("https://www.s"), F.col("l_suppkey").cast("string"), F.lit(".example/p")).alias("url"), F.lit("t").alias("title"))
    made = l.groupBy(F.col("l_orderkey").cast("string").alias("keyword")).agg(F.collect_list(item).alias("items")).select("keyword", F.to_json(F.struct("items")).alias("json"))
    return landing.serp_items(made)


@query("matched_properties", """WITH s AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN 'sc-domain:' || domain WHEN 1 THEN 'https://www.' || domain || '/' ELSE 'http://' || domain || '/' END AS site, domain, id % 11 <> 0 AS ok FROM projects WHERE domain IS NOT NULL),
f AS (SELECT domain, coalesce(max(CASE WHEN starts_with(site, 'sc-') THEN site END), max(CASE WHEN starts_with(site, 'https') THEN site END), max(CASE WHEN starts_with(site, 'http:') THEN site END)) AS found FROM s WHERE ok GROUP BY domain)
SELECT p.id AS project_id, coalesce(nullif(p.gsc_property, ''), found) AS property FROM (SELECT DISTINCT id, domain, gsc_property FROM projects) p LEFT JOIN f USING (domain)""")
def matched_properties(spark, d):
    p = table(spark, d, "projects").select("id", "domain", F.col("gsc_property").alias("saved")).distinct()
    form = F.when(F.col("id") % 3 == 0, F.concat(F.lit("sc-domain:"), "domain")).when(F.col("id") % 3 == 1, F.concat(F.lit("https://www."), "domain", F.lit("/"))).otherwise(F.concat(F.lit("http://"), "domain", F.lit("/")))
    return answers.match_property(p, p.select(form.alias("site_url"), F.when(F.col("id") % 11 == 0, "siteUnverifiedUser").otherwise("siteOwner").alias("permission")).where("site_url is not null"))


# ---------------------------------------------------------------- listings, histories, graph

@query("issue_listing", f"WITH {_ISSUES} SELECT audit_id, url, code, message FROM i WHERE severity = 'warning' AND audit_id = (SELECT min(audit_id) FROM i) ORDER BY url, code, message LIMIT 50")
def issue_listing(spark, d):
    i = issues_once(spark, d)
    first = i.agg(F.min("audit_id").alias("audit_id"))
    return listing.list_issues(i.join(F.broadcast(first), "audit_id", "left_semi"), severity="warning")[0].select("audit_id", "url", "code", "message")


@query("page_sample", """WITH s AS (SELECT url, max(word_count)::DOUBLE AS score FROM pages WHERE word_count > 900 GROUP BY url), e AS (SELECT url, min(depth) AS depth FROM pages WHERE status = 200 AND contains(lower(coalesce(nullif(content_type, ''), 'text/html')), 'html') AND url IS NOT NULL GROUP BY url)
SELECT e.url, CASE WHEN score IS NOT NULL THEN 2 ELSE 3 END AS level FROM e LEFT JOIN s USING (url) ORDER BY level, score DESC NULLS LAST, depth NULLS FIRST, e.url LIMIT 40""")
def page_sample(spark, d):
    p = table(spark, d, "pages").where("url is not null")
    one = p.where(listing.eligible(F.col("status"), F.col("content_type"))).groupBy("url").agg(F.min("depth").alias("depth")).withColumn("status", F.lit(200)).withColumn("content_type", F.lit("text/html"))
    scores = p.where("word_count > 900").groupBy(F.col("url").alias("node")).agg(F.max("word_count").cast("double").alias("score"))
    return listing.sample_pages(one, scores, "https://none.example/", [], 40)


@query("link_chains", """WITH h AS (SELECT l_orderkey, list({'f': l_partkey % 4, 's': CASE l_linenumber % 3 WHEN 0 THEN 302 WHEN 1 THEN 301 ELSE 200 END} ORDER BY l_linenumber) AS hops FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey::VARCHAR AS url, len(hops)::INT AS hops, len(hops) > 1 AS is_chain, len(list_distinct(list_transform(hops, lambda x: x.f))) < len(hops) AS is_loop,
  len(list_filter(hops, lambda x: x.s = 302))::INT AS temporary, len(list_filter(hops, lambda x: x.s = 301))::INT AS permanent FROM h""")
def link_chains(spark, d):
    """Redirects of several hops, with chains and loops."""
    l = table(spark, d, "lineitem")  # noqa: E741
    status = F.when(F.col("l_linenumber") % 3 == 0, 302).when(F.col("l_linenumber") % 3 == 1, 301).otherwise(200)
    hop = F.struct("l_linenumber", (F.col("l_partkey") % 4).cast("string").alias("from"), F.lit("x").alias("to"), status.alias("status"))
    return duplicates.redirect_report(l.groupBy(F.col("l_orderkey").cast("string").alias("url")).agg(F.array_sort(F.collect_list(hop)).alias("redirect_chain")))


@query("rank_moves", f"""WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY id DESC) AS n FROM c WHERE status <> 'skipped'), g AS (SELECT keyword_id, max(position) FILTER (n = 1) AS position, max(position) FILTER (n = 2) AS previous FROM r WHERE n <= 2 GROUP BY keyword_id)
SELECT *, previous - position AS change FROM g WHERE previous - position <> 0 ORDER BY abs(previous - position) DESC, keyword_id LIMIT 10""")
def rank_moves(spark, d):
    return listing.biggest_moves(external.rank_overview(_checks(spark, d)), 10)


@query("rank_series", f"WITH {_CHECKS}, s AS (SELECT keyword_id, id, CASE WHEN status <> 'skipped' THEN position END AS position FROM c) SELECT *, greatest(10, max(position) OVER (PARTITION BY keyword_id)) AS max_position FROM s")
def rank_series(spark, d):
    return listing.gap_series(_checks(spark, d))


@query("rank_history", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id AS id, user_id AS keyword_id FROM events, m WHERE ts >= t - INTERVAL 5 DAY")
def rank_history(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("t")).first().t
    return listing.history_since(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("keyword_id"), F.col("ts").alias("checked_at")), "keyword_id", F.lit(now), 5).select("id", "keyword_id")


@query("severity_tally", f"WITH {_ISSUES} SELECT audit_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM i GROUP BY audit_id")
def severity_tally(spark, d):
    return listing.severity_tally(issues_once(spark, d), "audit_id")


@query("alias_links", "WITH a AS (SELECT url, min(alias_of) AS t FROM pages WHERE alias_of IS NOT NULL GROUP BY url) SELECT p.src, coalesce(t, p.dst) AS dst FROM (SELECT DISTINCT final_url AS src, url AS dst FROM pages WHERE url IS NOT NULL) p LEFT JOIN a ON a.url = p.dst")
def alias_links(spark, d):
    p = table(spark, d, "pages")
    return listing.resolve_aliases(p.where("url is not null").select(F.col("final_url").alias("src"), F.col("url").alias("dst")).distinct(), p)


@query("frontier_rest", "SELECT DISTINCT canonical AS url FROM pages WHERE canonical IS NOT NULL AND canonical NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def frontier_rest(spark, d):
    p = table(spark, d, "pages")
    return listing.not_yet_seen(p.where("canonical is not null").select(F.col("canonical").alias("url")), p.where("url is not null"))


@query("due_projects", "WITH m AS (SELECT max(created_at) AS t FROM projects) SELECT DISTINCT id FROM projects, m WHERE (audit_schedule = 'daily' AND t - created_at >= INTERVAL 24 HOUR) OR (audit_schedule = 'weekly' AND t - created_at >= INTERVAL 168 HOUR)")
def due_projects(spark, d):
    p = table(spark, d, "projects")
    now = p.agg(F.max("created_at").alias("t")).first().t
    return listing.due(p, "audit_schedule", "created_at", F.lit(now)).select("id").distinct()


@query("architecture", f"""WITH {_E}, n AS (SELECT p_partkey AS url, p_size % 6 AS depth, CASE WHEN p_size % 9 = 0 THEN 404 WHEN p_size % 9 <> 1 THEN 200 END AS status FROM part), o AS (SELECT src, count(*) AS k FROM e GROUP BY src), i AS (SELECT dst, count(*) AS k FROM e GROUP BY dst)
SELECT url, depth, coalesce(i.k, 0) AS links_in, coalesce(o.k, 0) AS links_out, coalesce(status >= 400, true) AS broken, coalesce(i.k, 0) = 0 AND depth > 0 AS orphan, coalesce(o.k, 0) = 0 AS dead_end, depth >= 3 AS deep, coalesce(o.k, 0) > 20 AS hub FROM n LEFT JOIN o ON o.src = url LEFT JOIN i ON i.dst = url""")
def architecture(spark, d):
    size = F.col("p_size")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("url"), (size % 6).alias("depth"), F.when(size % 9 == 0, 404).when(size % 9 != 1, 200).alias("status"))
    return graph.architecture_flags(n, _edges(spark, d), hub_links=20)


@query("hub_table", f"WITH {_E}, h AS (SELECT src AS node, count(*) AS links FROM e GROUP BY src HAVING count(*) > 15 ORDER BY links DESC, node LIMIT 20) SELECT node, links, p_name AS title, p_size AS status, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0::DOUBLE END AS score FROM h LEFT JOIN part ON p_partkey = node")
def hub_table(spark, d):
    p = table(spark, d, "part")
    scores = _nodes(spark, d).join(p.select(F.col("p_partkey").alias("node"), "p_size"), "node").where("p_size % 2 = 0").select("node", (F.col("p_size") / 2).alias("score"))
    return listing.hub_table(graph.hubs(_edges(spark, d), 15, 20), p.select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title"), F.col("p_size").alias("status")), scores)


@query("code_changes", "WITH n AS (SELECT DISTINCT audit_id // 3 AS k, code FROM audit_issues WHERE audit_id % 3 = 1), o AS (SELECT DISTINCT audit_id // 3 AS k, code FROM audit_issues WHERE audit_id % 3 = 0) SELECT *, 'new' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def code_changes(spark, d):
    i = table(spark, d, "audit_issues").withColumn("k", F.expr("audit_id div 3"))
    return history.code_changes(i.where("audit_id % 3 = 1"), i.where("audit_id % 3 = 0"), "k")


@query("newest_audits", "SELECT project_id, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, id DESC) AS n FROM (SELECT DISTINCT id, project_id, finished_at FROM audits)) WHERE n <= 3")
def newest_audits(spark, d):
    return history.newest(table(spark, d, "audits").select("id", "project_id", "finished_at").distinct(), ["project_id"], [F.desc("finished_at"), F.desc("id")], 3).select("project_id", "id")


@query("beyond_retention", "SELECT id FROM (SELECT *, row_number() OVER (ORDER BY finished_at DESC NULLS LAST, id DESC) AS n FROM (SELECT DISTINCT id, finished_at FROM audits)) WHERE n > 20")
def beyond_retention(spark, d):
    return history.beyond_retention(table(spark, d, "audits").select("id", F.col("finished_at").alias("saved_at")).distinct()).select("id")


# ---------------------------------------------------------------- rendering, accessibility, rank targets, gaps, rates

def _versions(spark, d):
    p = table(spark, d, "pages").where("page_id is not null").groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("title", "meta_description", "h1", "canonical", "meta_robots", "word_count")])
    k = F.col("page_id")
    raw = p.withColumn("url", k.cast("string")).withColumn("links", F.array(F.lit("a"), (k % 7).cast("string")))
    rendered = (
        raw.withColumn("title", F.when(k % 3 == 0, F.concat("title", F.lit(" "))).when(k % 3 == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title"))).withColumn("h1", F.when(k % 4 != 0, F.col("h1")))
        .withColumn("word_count", F.when(k % 5 == 0, F.col("word_count") * 3).otherwise(F.col("word_count"))).withColumn("links", F.array(F.lit("a"), F.lit("b"), (k % 6).cast("string")))
    )
    return raw, rendered


@query("render_changes", """WITH p AS (SELECT page_id, max(title) AS title, max(h1) AS h1, coalesce(max(word_count), 0) AS w FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
l AS (SELECT *, 1 + CASE WHEN page_id % 6 <> page_id % 7 THEN 1 ELSE 0 END AS extra FROM p)
SELECT page_id::VARCHAR AS url, extra::INT AS js_only_links_count, concat_ws(',', CASE WHEN page_id % 5 = 0 AND w * 2 >= 200 THEN 'JS_CONTENT_DEPENDENT' END, CASE WHEN page_id % 3 = 1 AND title IS NOT NULL THEN 'JS_TITLE_CHANGED' END,
  CASE WHEN page_id % 4 = 0 AND trim(coalesce(h1, '')) <> '' THEN 'JS_H1_CHANGED' END, 'JS_ONLY_LINKS') AS codes, extra || ' internal ' || CASE WHEN extra = 1 THEN 'link appears' ELSE 'links appear' END || ' only after JavaScript' AS last_message FROM l""")
def render_changes(spark, d):
    r = external.render_comparison(*_versions(spark, d))
    return r.select("url", "js_only_links_count", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), F.element_at("issues", -1)["message"].alias("last_message"))


@query("accessibility", """WITH v AS (SELECT l_orderkey, 'rule-' || l_partkey % 9 AS id, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'serious' ELSE 'minor' END AS impact, CASE l_returnflag WHEN 'R' THEN 10 WHEN 'A' THEN 7 ELSE 1 END AS lost FROM lineitem)
SELECT l_orderkey::VARCHAR AS url, greatest(0, 100 - sum(lost))::INT AS score, count(*) FILTER (impact = 'critical')::INT AS critical, count(*) FILTER (impact = 'serious')::INT AS serious, count(*) FILTER (impact = 'minor')::INT AS minor,
  string_agg('A11Y_' || upper(replace(id, '-', '_')), ',' ORDER BY CASE impact WHEN 'critical' THEN 1 WHEN 'serious' THEN 2 ELSE 4 END, id) AS codes FROM v GROUP BY l_orderkey""")
def accessibility(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    impact = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "serious").otherwise("odd")
    v = F.struct(F.concat(F.lit("rule-"), (F.col("l_partkey") % 9).cast("string")).alias("id"), impact.alias("impact"), F.lit(1).alias("nodes_count"))
    s = external.accessibility_summary(l.groupBy(F.col("l_orderkey").cast("string").alias("url")).agg(F.collect_list(v).alias("violations")))
    return s.select("url", "score", *[F.col("counts")[k].alias(k) for k in ("critical", "serious", "minor")], F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query("result_positions", """WITH r AS (SELECT l_orderkey AS keyword, l_linenumber AS position, CASE WHEN l_partkey % 2 = 0 THEN 'blog.' ELSE '' END || 's' || l_suppkey % 20 || '.example' AS domain FROM lineitem)
SELECT keyword, 'me' || n AS owner, min(position) AS position FROM r, range(5) t(n) WHERE domain = 's' || n || '.example' OR domain LIKE '%.s' || n || '.example' GROUP BY 1, 2""")
def result_positions(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    domain = F.concat(F.when(F.col("l_partkey") % 2 == 0, "blog.").otherwise(""), F.lit("s"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example"))
    serp = l.select(F.col("l_orderkey").alias("keyword"), F.col("l_linenumber").alias("position"), F.lit("u").alias("url"), domain.alias("domain"))
    mine = spark.range(5).select(F.concat(F.lit("me"), F.col("id").cast("string")).alias("owner"), F.concat(F.lit("S"), F.col("id").cast("string"), F.lit(".example")).alias("domain"))
    return external.result_positions(serp, mine).drop("url")


@query("rank_targets", "WITH s AS (SELECT l_orderkey AS keyword, l_partkey % 10 AS p, min(l_linenumber) AS position FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2) SELECT o_orderkey AS keyword, 'http://www.e.example/' || o_custkey % 10 || '/?q#f' AS url, position FROM orders LEFT JOIN s ON s.keyword = o_orderkey AND s.p = o_custkey % 10")
def rank_targets(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")  # noqa: E741
    serp = l.select(F.col("l_orderkey").alias("keyword"), F.col("l_linenumber").alias("position"), F.concat(F.lit("https://e.example/"), (F.col("l_partkey") % 10).cast("string")).alias("url"))
    return external.rank_target_hits(o.select(F.col("o_orderkey").alias("keyword"), F.concat(F.lit("http://www.e.example/"), (F.col("o_custkey") % 10).cast("string"), F.lit("/?q#f")).alias("url")), serp, 5)


@query("keyword_table", """WITH i AS (SELECT p_partkey % 300 AS keyword, arg_min(p_brand, p_partkey) AS source FROM part GROUP BY 1) SELECT keyword, source, CASE WHEN keyword % 3 <> 0 THEN keyword END AS search_volume, CASE WHEN keyword % 2 = 0 THEN keyword END AS keyword_difficulty, CASE WHEN keyword % 3 <> 0 THEN round_even(keyword * 0.28, 0)::BIGINT END AS traffic_estimate FROM i""")
def keyword_table(spark, d):
    k = (F.col("p_partkey") % 300).alias("keyword")
    p = table(spark, d, "part")
    ideas = p.select(k, F.col("p_brand").alias("source"), F.col("p_partkey").alias("ord"))
    known = p.select(k).distinct()
    return external.keyword_table(ideas, known.where("keyword % 3 <> 0").withColumn("search_volume", F.col("keyword")), known.where("keyword % 2 = 0").withColumn("keyword_difficulty", F.col("keyword")))


@query("phrase_gap", "SELECT l_partkey % 500 AS phrase, count(DISTINCT l_suppkey) AS pages FROM lineitem WHERE l_suppkey <> 1 AND l_partkey % 500 NOT IN (SELECT l_partkey % 500 FROM lineitem WHERE l_suppkey = 1) GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def phrase_gap(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 500).alias("phrase"))  # noqa: E741
    return external.phrase_gap(l.where("page = 1"), l.where("page <> 1"))


@query("mention_rates", """WITH a AS (SELECT o_orderkey, o_custkey % 4 AS run_id, o_orderpriority AS provider, o_orderkey % 3 = 0 AS cited, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 + 1 END AS rank FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT *, provider AS pr FROM a UNION ALL SELECT *, NULL FROM a)
SELECT run_id, pr AS provider, count(*) AS answers, round(avg((rank IS NOT NULL)::INT), 3) AS mention_rate, round(avg(cited::INT), 3) AS cited_rate, round(avg(rank), 2) AS avg_position FROM b GROUP BY run_id, pr""")
def mention_rates(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.select(k.alias("answer_id"), (F.col("o_custkey") % 4).alias("run_id"), F.col("o_orderpriority").alias("provider"), F.when(k % 7 == 0, "failed").alias("error"), (k % 3 == 0).alias("cited"))
    return external.mention_rates(a, o.where("o_orderkey % 4 = 0").select(k.alias("answer_id"), F.lit("me").alias("owner"), (k % 5 + 1).alias("rank")), "me")


@query("answer_citations", "WITH c AS (SELECT l_orderkey AS answer_id, CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN 'title' || l_suppkey % 8 || '.example' ELSE 's' || l_suppkey % 8 || '.example' END AS domain, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT answer_id, domain, row_number() OVER (PARTITION BY answer_id ORDER BY o, domain)::INT AS ord FROM c WHERE domain IS NOT NULL")
def answer_citations(spark, d):
    n, s = F.col("l_linenumber"), (F.col("l_suppkey") % 8).cast("string")
    behind = F.when(n == 2, "https://vertexaisearch.cloud.google.com/x").when(n == 3, "https://a.googleusercontent.com/y").otherwise(F.concat(F.lit("https://www.s"), s, F.lit(".example/p")))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), n.alias("ord"), behind.alias("url"), F.when(n == 3, F.concat(F.lit(" Title"), s, F.lit(".example"))).otherwise(F.lit("A page")).alias("title"))
    return external.answer_citations(c)


# ---------------------------------------------------------------- writing and streams

@query("upserted_pages", "WITH o AS (SELECT page_id, max(title) AS title FROM pages GROUP BY page_id), n AS (SELECT page_id, 'new' AS title FROM o WHERE page_id % 4 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE page_id NOT IN (SELECT page_id FROM n)")
def upserted_pages(spark, d):
    stored = table(spark, d, "pages").groupBy("page_id").agg(F.max("title").alias("title"))
    return sinks.upsert(stored, stored.where("page_id % 4 = 0").withColumn("title", F.lit("new")), ["page_id"])


@query("counted_pages", f"WITH {_ISSUES}, n AS (SELECT audit_id, url, count(*)::INT AS c FROM i GROUP BY audit_id, url) SELECT p.audit_id, p.url, coalesce(c, 0) AS issue_count FROM (SELECT DISTINCT audit_id, url FROM audit_pages WHERE url IS NOT NULL) p LEFT JOIN n USING (audit_id, url)")
def counted_pages(spark, d):
    return sinks.with_issue_counts(table(spark, d, "audit_pages").where("url is not null").select("audit_id", "url").distinct(), issues_once(spark, d), ["audit_id", "url"]).select("audit_id", "url", "issue_count")


@query("audit_rows", "SELECT audit_id, count(*) FILTER (alias_of IS NULL AND duplicate_of IS NULL) AS page_count FROM audit_pages GROUP BY audit_id")
def audit_rows(spark, d):
    return sinks.audit_row(table(spark, d, "audit_pages"))


@query("cached_answers", "WITH m AS (SELECT max(ts) AS t FROM events), l AS (SELECT event_type AS provider, user_id AS request_hash, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT provider, request_hash::VARCHAR AS request_hash, epoch_us(ts) AS at_us FROM l, m WHERE t - ts <= INTERVAL 72 HOUR")
def cached_answers(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("t")).first().t
    c = e.select(F.col("event_type").alias("provider"), F.lit("x").alias("endpoint"), F.col("user_id").cast("string").alias("request_hash"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("value").alias("answer"))
    return sinks.cached_answers(c, F.lit(now).cast("timestamp"), 72).select("provider", "request_hash", F.unix_micros("fetched_at").alias("at_us"))


@query("merged_days", "WITH a AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT k, day::VARCHAR AS day, CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS n FROM a")
def merged_days(spark, d):
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return external.merge_daily(a, a.where("k % 3 = 0").withColumn("n", F.lit(0).cast("long")), ["k", "day"]).withColumn("day", F.col("day").cast("string"))


@query("new_alerts", f"WITH {_CHECKS} SELECT DISTINCT keyword_id AS rank_check_id, status AS kind, 'mail' AS channel FROM c WHERE NOT (keyword_id % 3 = 0 AND status = 'ranked')")
def new_alerts(spark, d):
    a = _checks(spark, d).select(F.col("keyword_id").alias("rank_check_id"), F.col("status").alias("kind"), F.lit("mail").alias("channel"))
    return streams.new_alerts(a, a.where("rank_check_id % 3 = 0 and kind = 'ranked'"))


@query("missing_sessions", "SELECT DISTINCT session_id FROM audits WHERE session_id NOT IN (SELECT session_id FROM audits WHERE status = 'completed' AND session_id IS NOT NULL)")
def missing_sessions(spark, d):
    a = table(spark, d, "audits").where("session_id is not null").select("session_id", "status")
    return landing.missing_sessions(a, a.where("status = 'completed'")).select("session_id")


@query("crawl_progress", """WITH p AS (SELECT user_id::VARCHAR AS session_id, count(*) AS pages, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT session_id, pages, round(least(pages / 50.0::DOUBLE * 100, 100.0), 1)::DOUBLE AS percent FROM p""")
def crawl_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "view", "page_crawled").otherwise(F.col("event_type")).alias("kind"), F.col("ts").alias("at"))
    return streams.progress(e, 50).select("session_id", "pages", "percent")


@query("conditional_requests", "WITH c AS (SELECT url, max(etag) AS etag, max(last_modified) AS lm FROM page_cache WHERE url IS NOT NULL GROUP BY url) SELECT url, nullif(etag, '') AS etag, nullif(lm, '') AS last_modified FROM c")
def conditional_requests(spark, d):
    c = table(spark, d, "page_cache").where("url is not null").groupBy("url").agg(F.max("etag").alias("etag"), F.max("last_modified").alias("last_modified"))
    h = landing.conditional_headers(c.select("url"), c)
    return h.select("url", F.col("request_headers")["If-None-Match"].alias("etag"), F.col("request_headers")["If-Modified-Since"].alias("last_modified"))


QUERIES = Q
