"""Queries of the audit operators over the delivered tables, with their SQL.

Tables stand in as follows: link graphs are parts that follow each other in an order, rank checks are
events of a user, ranked keywords are parts of a supplier with the quantity as position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import texts as X
from auditloom.functions import urls as U
from auditloom.operators import checks, duplicates, graph, history, listing, rules, scoring, similarity
from auditloom.operators.advice import A11Y_ADVICE, ADVICE
from auditloom.operators.html_facts import page_facts
from auditloom.operators.snapshots import consecutive_audits, latest_versions
from auditloom.sources.tables import table

Q: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of session and folder under a name."""
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def pages_once(spark, d) -> DataFrame:
    """Distinct page records."""
    return table(spark, d, "pages").distinct()


def issues_once(spark, d) -> DataFrame:
    """Issue rows, each delivered once."""
    return table(spark, d, "audit_issues").distinct()


def audit_pages_once(spark, d) -> DataFrame:
    """The last version of each page of each audit."""
    return latest_versions(table(spark, d, "audit_pages"), ["audit_id", "url"], "id", ["status", "depth", "title", "issue_count", "alias_of", "duplicate_of"])


_ISSUES = "i AS (SELECT DISTINCT * FROM audit_issues)"
_AUDIT_PAGES = """ap AS (SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY audit_id, url ORDER BY id DESC) AS n FROM audit_pages) WHERE n = 1)"""
_COUNTS = "pc AS (SELECT audit_id, count(*) AS pages FROM ap WHERE alias_of IS NULL AND duplicate_of IS NULL GROUP BY audit_id)"


def _counts(spark, d):
    return audit_pages_once(spark, d).where("alias_of is null and duplicate_of is null").groupBy("audit_id").agg(F.count("*").alias("pages"))


# ---------------------------------------------------------------- addresses

_RE = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$'"


def _part(c: str, n: int) -> str:
    return f"regexp_extract(trim({c}, ' '), {_RE}, {n})"


def _normal(c: str) -> str:
    tracking = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMETERS)
    scheme, host, path, query_ = f"lower({_part(c, 1)})", f"lower({_part(c, 2)})", _part(c, 3), _part(c, 4)
    name = "lower(split_part(p, '=', 1))"
    kept = f"list_filter(string_split({query_}, '&'), lambda p: p <> '' AND NOT starts_with({name}, 'utm_') AND {name} NOT IN ({tracking}))"
    keyed = f"list_transform({kept}, lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'p': p}})"
    rest = f"coalesce(array_to_string(list_transform(list_sort({keyed}), lambda x: x.p), '&'), '')"
    host = f"(CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END)"
    return (
        f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || "
        f"CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '/{{2,}}', '/', 'g') END || CASE WHEN {rest} <> '' THEN '?' || {rest} ELSE '' END)"
    )


@query("url_normalize", f"SELECT DISTINCT url, {_normal('url')} AS normal FROM pages WHERE url IS NOT NULL")
def url_normalize(spark, d):
    return table(spark, d, "pages").where("url is not null").select("url").distinct().select("url", U.normalize_url(F.col("url")).alias("normal"))


@query("url_keys", f"""
SELECT DISTINCT url, regexp_replace(regexp_replace(regexp_replace(lower({_part('url', 2)}), '^.*@', ''), ':\\d*$', ''), '^www\\.', '') AS domain,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url, ' '), '[#?][\\s\\S]*$', ''), '^https?://', ''), '^www\\.', ''), '/+$', '') AS rank_key,
  lower(regexp_replace(trim(url, ' '), '/+$', '')) AS metrics_key
FROM pages WHERE url IS NOT NULL""")
def url_keys(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").where("url is not null").select("url").distinct().select(
        "url", U.domain_of(u).alias("domain"), U.rank_key(u).alias("rank_key"), U.metrics_key(u).alias("metrics_key")
    )


@query("url_issues", f"""
WITH p AS (SELECT DISTINCT url, {_part('url', 3)} AS path, {_part('url', 4)} AS q FROM pages WHERE url IS NOT NULL),
n AS (SELECT *, len(list_distinct(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_full_match(x, '[^=]*=[\\s\\S]+')), lambda x: split_part(x, '=', 1)))) AS params FROM p)
SELECT url, 'info' AS severity, 'URL_UPPERCASE' AS code, 'URL path contains uppercase characters' AS message FROM n WHERE regexp_matches(path, '\\p{{Lu}}')
UNION ALL SELECT url, 'info', 'URL_UNDERSCORE', 'URL uses underscores instead of hyphens' FROM n WHERE contains(path, '_')
UNION ALL SELECT url, 'info', 'URL_TOO_LONG', 'URL is long (' || length(url) || ' chars)' FROM n WHERE length(url) > 115
UNION ALL SELECT url, 'info', 'TOO_MANY_PARAMS', 'URL has ' || params || ' query parameters' FROM n WHERE params > 3""")
def url_issues(spark, d):
    df = table(spark, d, "pages").where("url is not null").select("url").distinct()
    return checks.explode_issues(df, ["url"], checks.url_issues(F.col("url")))


# ---------------------------------------------------------------- page checks on columns

@query("page_issues", f"""
WITH p AS (SELECT DISTINCT * FROM pages), x AS (SELECT *, trim(coalesce(meta_description, ''), ' ') AS md FROM p)
SELECT page_id, 'critical' AS severity, 'MISSING_TITLE' AS code, 'Missing <title> tag' AS message FROM x WHERE title IS NULL
UNION ALL SELECT page_id, 'critical', 'EMPTY_TITLE', 'Title tag is empty' FROM x WHERE title = ''
UNION ALL SELECT page_id, 'info', 'TITLE_TOO_SHORT', 'Title is short (' || length(title) || ' chars)' FROM x WHERE length(title) BETWEEN 1 AND 14
UNION ALL SELECT page_id, 'info', 'TITLE_TOO_LONG', 'Title may be truncated in SERPs (' || length(title) || ' chars)' FROM x WHERE length(title) > 60
UNION ALL SELECT page_id, 'warning', 'MISSING_META_DESCRIPTION', 'Missing meta description' FROM x WHERE md = ''
UNION ALL SELECT page_id, 'info', 'META_DESC_TOO_SHORT', 'Meta description is short (' || length(md) || ' chars)' FROM x WHERE length(md) BETWEEN 1 AND 49
UNION ALL SELECT page_id, 'info', 'META_DESC_TOO_LONG', 'Meta description may be truncated (' || length(md) || ' chars)' FROM x WHERE length(md) > 160
UNION ALL SELECT page_id, 'warning', 'THIN_CONTENT', 'Thin content: only ' || word_count || ' words' FROM x WHERE word_count < 150
UNION ALL SELECT page_id, 'warning', 'NOINDEX', 'Page is set to noindex' FROM x WHERE contains(lower(coalesce(meta_robots, '')), 'noindex')
UNION ALL SELECT page_id, 'info', 'NOFOLLOW', 'Page is set to nofollow' FROM x WHERE contains(lower(coalesce(meta_robots, '')), 'nofollow')
UNION ALL SELECT page_id, 'critical', 'FETCH_ERROR', 'Failed to fetch: ' || error FROM x WHERE coalesce(error, '') <> ''
UNION ALL SELECT page_id, 'critical', 'NO_RESPONSE', 'No response received' FROM x WHERE coalesce(error, '') = '' AND status IS NULL
UNION ALL SELECT page_id, 'critical', 'STATUS_404', 'Page returns 404 Not Found' FROM x WHERE coalesce(error, '') = '' AND status = 404
UNION ALL SELECT page_id, 'warning', 'STATUS_410', 'Page returns 410 Gone' FROM x WHERE coalesce(error, '') = '' AND status = 410
UNION ALL SELECT page_id, 'critical', 'STATUS_' || status, 'Server error ' || status FROM x WHERE coalesce(error, '') = '' AND status >= 500
UNION ALL SELECT page_id, 'info', 'STATUS_' || status, 'Page redirects (' || status || ')' FROM x WHERE coalesce(error, '') = '' AND status IN (301, 302, 307, 308)
UNION ALL SELECT page_id, 'critical', 'NO_HTTPS', 'Page is served over HTTP, not HTTPS' FROM x WHERE coalesce(error, '') = '' AND lower({_part('url', 1)}) <> 'https'
""")
def page_issues(spark, d):
    c = F.col
    none = F.expr("cast(null as array<struct<from:string,to:string,status:int>>)")
    return checks.explode_issues(
        pages_once(spark, d), ["page_id"], checks.title_issues(c("title")), checks.description_issues(c("meta_description")), checks.thin_content(c("word_count")),
        checks.robots_issues(F.lit(""), c("meta_robots")), checks.status_issues(c("url"), c("status"), c("error"), none),
    )


def _cached_html(spark, d):
    """The html of each cached page, one row a url (the latest)."""
    cache = table(spark, d, "page_cache").where("url is not null")
    last = cache.groupBy("url").agg(F.max(F.struct("analysed_at", "html_blob")).alias("x")).select("url", F.col("x.html_blob").cast("string").alias("json"))
    return last.select("url", F.from_json("json", "html string", {"mode": "PERMISSIVE"})["html"].alias("html")).where("html is not null")


@query("html_full_audit")
def html_full_audit(spark, d):
    """All html checks of every cached page from one parse each."""
    f = page_facts(_cached_html(spark, d))
    return f.select("url", F.explode("html_issues").alias("i")).select("url", "i.severity", "i.code", "i.message")


@query("html_page_facts")
def html_page_facts(spark, d):
    """Counts and fields of every cached page."""
    return page_facts(_cached_html(spark, d)).select(
        "url", "title", "h1", "lang", "canonical", "word_count", "char_count", "h2_count", "h3_count", "internal_links_count", "external_links_count", "images_count", "html_bytes", "dom_nodes", "blocking_css", "blocking_js"
    )


@query("html_links")
def html_links(spark, d):
    """Distinct links of every cached page, internal or not."""
    return page_facts(_cached_html(spark, d)).select(F.col("url").alias("src"), F.explode("links").alias("l")).select("src", "l.dst", "l.internal")


# ---------------------------------------------------------------- scores

@query("issue_frequency", f"WITH {_ISSUES} SELECT audit_id, code, count(*) AS count FROM i GROUP BY audit_id, code")
def issue_frequency(spark, d):
    return scoring.issue_frequency(issues_once(spark, d), "audit_id")


_HEALTH = f"""WITH {_ISSUES}, {_AUDIT_PAGES}, {_COUNTS},
s AS (SELECT audit_id, sum(CASE severity WHEN 'critical' THEN 5.0 WHEN 'warning' THEN 2.0 WHEN 'info' THEN 0.5 ELSE 1.0 END)::DOUBLE AS w,
  count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS wn, count(*) FILTER (severity = 'info') AS n FROM i GROUP BY audit_id),
h AS (SELECT pc.audit_id, pages, round(greatest(0.0, least(100.0, 100 - coalesce(w, 0.0) / pages * 4)), 1)::DOUBLE AS score, c, wn, n FROM pc LEFT JOIN s USING (audit_id))"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


@query("health_scores", f"""{_HEALTH} SELECT audit_id, pages, score, {_GRADE} AS grade, coalesce(c, 0)::BIGINT AS critical_issues, coalesce(wn, 0)::BIGINT AS warning_issues, coalesce(n, 0)::BIGINT AS info_issues FROM h""")
def health_scores(spark, d):
    return scoring.health_scores(_counts(spark, d), issues_once(spark, d), "audit_id")


def _category_sql() -> str:
    hit = {c: "(" + " OR ".join(f"contains(code, '{p}')" for p in ps) + ")" for c, ps in scoring.CATEGORIES.items()}
    none = "NOT (" + " OR ".join(hit.values()) + ")"
    hit["technical_seo"] = f"({hit['technical_seo']} OR {none})"
    w = "CASE severity WHEN 'critical' THEN 5.0 WHEN 'warning' THEN 2.5 ELSE 1.0 END"
    parts = [
        f"SELECT pc.audit_id, '{c}' AS category, greatest(0.0, least(100.0, round(100 - coalesce(w, 0.0) / pages * 6, 1)))::DOUBLE AS score FROM pc LEFT JOIN "
        f"(SELECT audit_id, sum({w})::DOUBLE AS w FROM i WHERE {h} GROUP BY audit_id) USING (audit_id)" for c, h in hit.items()
    ]
    return f"WITH {_ISSUES}, {_AUDIT_PAGES}, {_COUNTS} " + " UNION ALL ".join(parts)


@query("category_scores", _category_sql())
def category_scores(spark, d):
    return scoring.category_scores(_counts(spark, d), issues_once(spark, d), "audit_id")


@query("page_scores", f"""WITH {_ISSUES}, s AS (SELECT audit_id, url, count(*) FILTER (severity = 'critical') AS critical_issues, count(*) FILTER (severity = 'warning') AS warning_issues,
  count(*) FILTER (severity = 'info') AS info_issues, array_to_string(list_sort(list(DISTINCT code)), ', ') AS issue_codes FROM i GROUP BY audit_id, url)
SELECT *, greatest(0, least(100, 100 - 15 * critical_issues - 5 * warning_issues - info_issues))::BIGINT AS seo_score FROM s""")
def page_scores(spark, d):
    return scoring.page_scores(issues_once(spark, d), ["audit_id", "url"])


def _case(c: str, table: dict, otherwise: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"CASE {c} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def recommendations_sql(issues: str, key: str) -> str:
    """The SQL of ``scoring.recommendations`` over a relation of issues."""
    advised = _case("code", ADVICE, f"CASE WHEN starts_with(code, 'A11Y_') THEN '{A11Y_ADVICE}' END")
    return f"""u AS (SELECT {key}, code, url, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS s, min(message) AS message FROM {issues} GROUP BY {key}, code, url),
g AS (SELECT {key}, code, max(s) AS s, count(*) AS affected_pages, min(message) AS m, array_to_string(list_slice(list_sort(list(url)), 1, 5), ' ') AS example_urls, CASE WHEN code = 'ORPHAN_PAGES' THEN 6 ELSE {_case("code", scoring.IMPACT, "2")} END AS w FROM u GROUP BY {key}, code)
SELECT {key}, code, CASE s WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, affected_pages, (w * least(affected_pages, 50))::BIGINT AS priority_score,
  CASE WHEN w >= 7 OR code = 'ORPHAN_PAGES' THEN 'High' WHEN w >= 4 THEN 'Medium' ELSE 'Low' END AS impact,
  CASE WHEN code IN ({', '.join(repr(x) for x in [*scoring.QUICK_WINS, 'ORPHAN_PAGES'])}) THEN 'Quick Win' WHEN w >= 8 THEN 'Major' ELSE 'Moderate' END AS estimated_effort, example_urls, coalesce({advised}, m, code) AS recommendation FROM g"""


@query("recommendations", f"WITH {_ISSUES}, {recommendations_sql('i', 'audit_id')}")
def recommendations(spark, d):
    return scoring.recommendations(issues_once(spark, d), "audit_id").withColumn("example_urls", F.array_join("example_urls", " "))


@query("executive_summary", f"""{_HEALTH}, st AS (SELECT audit_id, string_agg(k || ':' || n, ',' ORDER BY k) AS statuses FROM (
  SELECT audit_id, coalesce(status::VARCHAR, 'none') AS k, count(*) AS n FROM ap WHERE alias_of IS NULL AND duplicate_of IS NULL GROUP BY 1, 2) GROUP BY audit_id)
SELECT audit_id, pages, score, {_GRADE} AS grade, coalesce(c, 0)::BIGINT AS critical_issues, coalesce(wn, 0)::BIGINT AS warning_issues, coalesce(n, 0)::BIGINT AS info_issues, statuses FROM h LEFT JOIN st USING (audit_id)""")
def executive_summary(spark, d):
    out = scoring.executive_summary(audit_pages_once(spark, d), issues_once(spark, d), "audit_id")
    return out.withColumn("statuses", F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


# ---------------------------------------------------------------- duplicates and redirects

@query("duplicate_groups", " UNION ALL ".join(
    f"""SELECT p.audit_id, '{f}' AS field, p.value, p.url, g.pages FROM (SELECT DISTINCT audit_id, url, {f} AS value FROM pages WHERE {f} IS NOT NULL AND {f} <> '' AND url IS NOT NULL) p
JOIN (SELECT audit_id, {f} AS value, count(DISTINCT url) AS pages FROM pages WHERE {f} IS NOT NULL AND {f} <> '' AND url IS NOT NULL GROUP BY audit_id, {f} HAVING count(DISTINCT url) > 1) g USING (audit_id, value)"""
    for f in ("title", "meta_description", "h1", "canonical")
))
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(table(spark, d, "pages").where("url is not null and audit_id is not null"), "audit_id", ["title", "meta_description", "h1", "canonical"])


_SPACE = "'[\\s\\x{0085}\\x{000b}\\x{001c}-\\x{001f}\\p{Z}]+'"
_HASH = f"substr(sha256(lower(trim(regexp_replace(text, {_SPACE}, ' ', 'g'), ' '))), 1, 16)"


@query("duplicate_content", f"""SELECT content_hash, count(*) AS documents, min(doc_id) AS first_doc FROM (SELECT doc_id, {_HASH} AS content_hash FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY content_hash HAVING count(*) > 1""")
def duplicate_content(spark, d):
    docs = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


def _hops(spark, d):
    c = F.col
    hop = F.when((c("final_url") != c("url")), F.array(F.struct(c("url").alias("from"), c("final_url").alias("to"), F.coalesce("status", F.lit(301)).alias("status"))))
    return pages_once(spark, d).select("page_id", "url", F.coalesce(hop, F.expr("cast(array() as array<struct<from:string,to:string,status:int>>)")).alias("redirect_chain"))


@query("redirect_report", """SELECT url, count(*) AS records, max(CASE WHEN coalesce(status, 301) IN (302, 307) THEN 1 ELSE 0 END) AS temporary,
  max(CASE WHEN coalesce(status, 301) IN (301, 308) THEN 1 ELSE 0 END) AS permanent FROM (SELECT DISTINCT * FROM pages) WHERE final_url <> url GROUP BY url""")
def redirect_report(spark, d):
    return duplicates.redirect_report(_hops(spark, d)).groupBy("url").agg(F.count("*").alias("records"), F.max("temporary").alias("temporary"), F.max("permanent").alias("permanent"))


@query("broken_links", """WITH bad AS (SELECT DISTINCT url, status FROM pages WHERE status >= 400 OR status IS NULL),
l AS (SELECT DISTINCT url AS src, canonical AS dst FROM pages WHERE canonical IS NOT NULL AND url IS NOT NULL)
SELECT bad.url, status, count(src) AS links, coalesce(array_to_string(list_slice(list_sort(list(src) FILTER (src IS NOT NULL)), 1, 10), ' '), '') AS linked_from FROM bad LEFT JOIN l ON l.dst = bad.url GROUP BY bad.url, status""")
def broken_links(spark, d):
    p = table(spark, d, "pages")
    links = p.where("canonical is not null and url is not null").select(F.col("url").alias("src"), F.col("canonical").alias("dst"))
    return duplicates.broken_links(p, links).withColumn("linked_from", F.array_join("linked_from", " "))


# ---------------------------------------------------------------- depth, graph, clusters

@query("depth_histogram", f"WITH {_AUDIT_PAGES} SELECT audit_id, depth, count(*) AS pages FROM ap GROUP BY audit_id, depth")
def depth_histogram(spark, d):
    return audit_pages_once(spark, d).groupBy("audit_id", "depth").agg(F.count("*").alias("pages"))


@query("site_averages", """SELECT audit_id, count(*) AS pages, max(depth) AS max_depth, round(avg(depth), 2) AS avg_depth, round(avg(CASE WHEN response_time_ms >= 0 AND NOT isnan(response_time_ms) THEN response_time_ms END), 1) AS avg_response_ms
FROM (SELECT DISTINCT * FROM pages) GROUP BY audit_id""")
def site_averages(spark, d):
    ok = F.when((F.col("response_time_ms") >= 0) & ~F.isnan("response_time_ms"), F.col("response_time_ms"))
    return pages_once(spark, d).groupBy("audit_id").agg(
        F.count("*").alias("pages"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("avg_depth"), F.round(F.avg(ok), 1).alias("avg_response_ms")
    )


def _edges(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(l, ["l_orderkey", "l_linenumber"]).select("src", F.col("l_partkey").alias("dst")).distinct()


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


_E = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


@query("graph_degrees", f"WITH {_E} SELECT p_partkey AS node, (SELECT count(*) FROM e WHERE src = p_partkey) AS links_out, (SELECT count(*) FROM e WHERE dst = p_partkey) AS links_in FROM part")
def graph_degrees(spark, d):
    return graph.degrees(_nodes(spark, d), _edges(spark, d))


def _some_edges(spark, d):
    return _edges(spark, d).where("dst % 5 <> 0 and src % 7 <> 0")


_SOME = _E + ", k AS (SELECT * FROM e WHERE dst % 5 <> 0 AND src % 7 <> 0)"


@query("graph_orphans", f"WITH {_SOME} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM k) AND p_partkey <> 5")
def graph_orphans(spark, d):
    return graph.orphans(_nodes(spark, d), _some_edges(spark, d), 5)


@query("graph_dead_ends", f"WITH {_SOME} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM k)")
def graph_dead_ends(spark, d):
    return graph.dead_ends(_nodes(spark, d), _some_edges(spark, d))


@query("graph_hubs", f"WITH {_E} SELECT src AS node, count(*) AS links FROM e GROUP BY src HAVING count(*) > 15 ORDER BY links DESC, node LIMIT 20")
def graph_hubs(spark, d):
    return graph.hubs(_edges(spark, d), 15, 20)


@query("bfs_depths", f"""WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 8)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def bfs_depths(spark, d):
    return graph.bfs_depths(_edges(spark, d), 1, 8)


def _rank_sql(steps: int) -> str:
    parts = [f"WITH {_E}", "n AS (SELECT p_partkey AS node FROM part)", "c AS (SELECT count(*)::DOUBLE AS k FROM n)",
             "k AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n))",
             "s AS (SELECT node, node NOT IN (SELECT src FROM k) AS sink FROM n)", "r0 AS (SELECT s.node, sink, 1.0 / k AS score FROM s, c)"]
    for i in range(1, steps + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT r.node, r.sink, 0.15 / c.k + 0.85 * coalesce((SELECT sum(score) FROM r{i - 1} WHERE sink), 0) / c.k + 0.85 * coalesce(g.got, 0) AS score FROM r{i - 1} r CROSS JOIN c "
            f"LEFT JOIN (SELECT dst AS node, sum(q.score * k.w) AS got FROM k JOIN r{i - 1} q ON q.node = k.src GROUP BY dst) g ON g.node = r.node)"
        )
    return ", ".join(parts) + f" SELECT node, round(score, 8) AS score FROM r{steps}"


@query("page_rank", _rank_sql(10))
def page_rank(spark, d):
    return graph.page_rank(_nodes(spark, d), _edges(spark, d), iterations=10, tolerance=None).withColumn("score", F.round("score", 8))


@query("keyword_clusters", """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem),
p0 AS (SELECT a.g AS a, b.g AS b FROM l a JOIN l b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT a, b FROM p0 UNION SELECT b, a FROM p0), r AS (SELECT a AS n, a AS m FROM p UNION SELECT r.n, p.b FROM r JOIN p ON p.a = r.m)
SELECT n AS node, min(m) AS "group" FROM r GROUP BY n""")
def keyword_clusters(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("m"))
    return graph.linked_groups(graph.similar_sets(items, 2))


_SEG = f"coalesce('/' || nullif(list_filter(string_split({_part('url', 3)}, '/'), lambda x: x <> '')[1], ''), 'home')"


@query("path_clusters", f"""WITH c AS (SELECT audit_id, {_SEG} AS s, count(*) AS pages FROM (SELECT DISTINCT * FROM pages) WHERE url IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY pages DESC, s) AS n FROM c)
SELECT audit_id, CASE WHEN n <= 60 THEN s ELSE 'other' END AS cluster, sum(pages)::BIGINT AS pages FROM r GROUP BY 1, 2""")
def path_clusters(spark, d):
    return graph.clusters(pages_once(spark, d).where("url is not null"), U.segment_of(F.col("url"), F.lit("https://none.example")), "audit_id")


@query("cluster_edges", f"""WITH l AS (SELECT DISTINCT url, canonical FROM pages WHERE url IS NOT NULL AND canonical IS NOT NULL),
s AS (SELECT {_SEG} AS src, {_SEG.replace('(url', '(canonical')} AS dst FROM l) SELECT src, dst, count(*) AS links FROM s WHERE src <> dst GROUP BY src, dst""")
def cluster_edges(spark, d):
    l = table(spark, d, "pages").where("url is not null and canonical is not null").select(F.col("url").alias("src"), F.col("canonical").alias("dst")).distinct()  # noqa: E741
    return graph.cluster_edges(l, lambda c: U.segment_of(c, F.lit("https://none.example")))


# ---------------------------------------------------------------- audits against each other

_PAIRS = """pairs AS (SELECT * FROM (SELECT id AS audit_id, lag(id) OVER (PARTITION BY project_id ORDER BY finished_at NULLS FIRST, id) AS previous_id
  FROM (SELECT DISTINCT id, project_id, finished_at FROM audits WHERE status = 'completed')) WHERE previous_id IS NOT NULL)"""
_NOW = "ni AS (SELECT p.audit_id, url, code, severity, message FROM audit_issues i JOIN pairs p ON i.audit_id = p.audit_id)"
_OLD = "oi AS (SELECT p.audit_id, url, code, severity, message FROM audit_issues i JOIN pairs p ON i.audit_id = p.previous_id)"


def _diffs(spark, d):
    return history.audit_diffs(table(spark, d, "audits"), audit_pages_once(spark, d), table(spark, d, "audit_issues"))


@query("previous_audits", f"WITH {_PAIRS} SELECT * FROM pairs")
def previous_audits(spark, d):
    return consecutive_audits(table(spark, d, "audits"))


@query("issue_changes", f"""WITH {_PAIRS}, {_NOW}, {_OLD}
SELECT audit_id, url, code, min(severity) AS severity, min(message) AS message, 'new' AS change FROM ni WHERE NOT EXISTS (SELECT 1 FROM oi WHERE oi.audit_id = ni.audit_id AND oi.url = ni.url AND oi.code = ni.code) GROUP BY 1, 2, 3
UNION ALL SELECT audit_id, url, code, min(severity), min(message), 'fixed' FROM oi WHERE NOT EXISTS (SELECT 1 FROM ni WHERE oi.audit_id = ni.audit_id AND oi.url = ni.url AND oi.code = ni.code) GROUP BY 1, 2, 3""")
def issue_changes(spark, d):
    return _diffs(spark, d)["issues"]


@query("persisting_issues", f"WITH {_PAIRS}, {_NOW}, {_OLD} SELECT DISTINCT audit_id, url, code FROM ni WHERE EXISTS (SELECT 1 FROM oi WHERE oi.audit_id = ni.audit_id AND oi.url = ni.url AND oi.code = ni.code)")
def persisting_issues(spark, d):
    return _diffs(spark, d)["persisting"]


@query("page_set_changes", f"""WITH {_PAIRS}, {_AUDIT_PAGES}, n AS (SELECT p.audit_id, url FROM ap JOIN pairs p ON ap.audit_id = p.audit_id), o AS (SELECT p.audit_id, url FROM ap JOIN pairs p ON ap.audit_id = p.previous_id)
SELECT audit_id, url, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT audit_id, url, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def page_set_changes(spark, d):
    return _diffs(spark, d)["pages"]


@query("status_changes", f"""WITH {_PAIRS}, {_AUDIT_PAGES} SELECT p.audit_id, n.url, o.status AS old_status, n.status AS new_status FROM pairs p JOIN ap n ON n.audit_id = p.audit_id JOIN ap o ON o.audit_id = p.previous_id AND o.url = n.url WHERE o.status IS DISTINCT FROM n.status""")
def status_changes(spark, d):
    return _diffs(spark, d)["statuses"]


@query("score_changes", f"""WITH {_PAIRS}, s AS (SELECT id, max(health_score) AS score FROM audits GROUP BY id) SELECT audit_id, previous_id, o.score AS old_score, n.score AS score, round(n.score - o.score, 1) AS change FROM pairs JOIN s n ON n.id = audit_id JOIN s o ON o.id = previous_id""")
def score_changes(spark, d):
    return _diffs(spark, d)["scores"]


@query("project_cards", """WITH a AS (SELECT DISTINCT id, project_id, finished_at, health_score FROM audits), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY project_id) AS c FROM a),
p AS (SELECT id, max(name) AS name, max(domain) AS domain FROM projects GROUP BY id)
SELECT p.id AS project_id, name, domain, coalesce(c, 0) AS audits, r.id AS latest_audit_id, epoch_us(r.finished_at) AS latest_finished_us, r.health_score AS latest_score FROM p LEFT JOIN r ON r.project_id = p.id AND n = 1""")
def project_cards(spark, d):
    out = history.project_cards(table(spark, d, "projects"), table(spark, d, "audits"))
    return out.withColumn("latest_finished_us", F.unix_micros(F.col("latest_finished_at").cast("timestamp"))).drop("latest_finished_at")


# ---------------------------------------------------------------- rules, listings, text

RULES = [
    {"id": 1, "name": "Title present", "severity": "critical", "check": {"type": "field", "field": "title", "op": "is_not_empty"}},
    {"id": 2, "name": "Long pages", "severity": "info", "url_pattern": "/blog/*", "check": {"type": "field", "field": "word_count", "op": "gte", "value": "600"}},
    {"id": 3, "name": "No setup titles", "severity": "warning", "check": {"type": "field", "field": "title", "op": "not_contains", "value": "Setup"}},
    {"id": 4, "name": "Fine status", "severity": "critical", "check": {"type": "field", "field": "status", "op": "eq", "value": "200"}},
]


@query("custom_rules", """WITH f AS (SELECT url, min(trim(coalesce(title, ''), ' ')) AS title, min(word_count) AS word_count, min(status) AS status, 'https://' AS x FROM pages WHERE url IS NOT NULL GROUP BY url),
r AS (SELECT url, 1 AS rule_id, title <> '' AS ok FROM f
UNION ALL SELECT url, 2, coalesce(word_count, 0) >= 600 FROM f WHERE regexp_matches(CASE WHEN regexp_extract(trim(url, ' '), '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) = '' THEN '/' ELSE regexp_extract(trim(url, ' '), '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) END, '^/blog/')
UNION ALL SELECT url, 3, NOT contains(lower(title), 'setup') FROM f UNION ALL SELECT url, 4, coalesce(status, 0) = 200 FROM f)
SELECT rule_id, count(*) AS pages_checked, count(*) FILTER (NOT ok) AS pages_failed, coalesce(array_to_string(list_slice(list_sort(list(url) FILTER (NOT ok)), 1, 5), ' '), '') AS example_urls FROM r GROUP BY rule_id""")
def custom_rules(spark, d):
    facts = table(spark, d, "pages").where("url is not null").groupBy("url").agg(
        F.min(F.trim(F.coalesce("title", F.lit("")))).alias("title"), F.min("word_count").alias("word_count"), F.min("status").alias("status")
    )
    return rules.summarize(rules.evaluate(facts, RULES), RULES).select("rule_id", "pages_checked", "pages_failed", F.array_join("example_urls", " ").alias("example_urls"))


@query("page_listing", "SELECT url, word_count FROM (SELECT DISTINCT * FROM pages) WHERE url ILIKE '%/blog/%' AND issue_count > 0 ORDER BY word_count DESC NULLS LAST, url LIMIT 50")
def page_listing(spark, d):
    return listing.list_pages(pages_once(spark, d), text="/blog/", with_issues=True, sort="word_count", descending=True)[0].select("url", "word_count")


@query("slowest_pages", "SELECT url, response_time_ms FROM (SELECT DISTINCT url, response_time_ms FROM pages WHERE response_time_ms >= 0 AND NOT isnan(response_time_ms)) ORDER BY response_time_ms DESC, url LIMIT 10")
def slowest_pages(spark, d):
    p = table(spark, d, "pages").where("response_time_ms >= 0 and not isnan(response_time_ms)").select("url", "response_time_ms").distinct()
    return listing.top_by(p, "response_time_ms", 10)


def _phrase_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    fields = [("title", 3.0, 0), ("h1", 2.5, 1), ("meta_description", 2.0, 2)]
    f = " UNION ALL ".join(f"SELECT page_id, {at} AS pos, '{n}' AS field, {w}::DOUBLE AS weight, regexp_extract_all(lower(coalesce({n}, '')), '[a-z'']+') AS t FROM p" for n, w, at in fields)
    grams = " UNION ALL ".join(
        f"SELECT page_id, pos, field, weight, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS phrase, list_slice(t, i, i + {n - 1}) AS g FROM (SELECT *, unnest(range(1, greatest(1, len(t) - {n} + 2))) AS i FROM f)" for n in (1, 2, 3)
    )
    return f"""WITH p AS (SELECT page_id, max(title) AS title, max(h1) AS h1, max(meta_description) AS meta_description FROM pages GROUP BY page_id), f AS ({f}), x AS ({grams}),
s AS (SELECT page_id, phrase, round(sum(weight), 2) AS score, array_to_string(list_transform(list_sort(list(DISTINCT {{'pos': pos, 'f': field}})), lambda y: y.f), ',') AS found_in FROM x
  WHERE len(list_filter(g, lambda w: length(w) <= 2 OR w IN ({stop}))) = 0 GROUP BY page_id, phrase),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, phrase) AS rank FROM s) SELECT page_id, phrase, score, found_in, rank::INT AS rank FROM r WHERE rank <= 8"""


@query("page_keywords", _phrase_sql())
def page_keywords(spark, d):
    p = table(spark, d, "pages").groupBy("page_id").agg(F.max("title").alias("title"), F.max("h1").alias("h1"), F.max("meta_description").alias("meta_description"))
    return X.page_keywords(p, "page_id").withColumn("found_in", F.array_join("found_in", ","))


@query("keyword_density", f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)})) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, keyword, count(*) AS count, any_value(n) AS n FROM (SELECT doc_id, unnest(t) AS keyword, len(t) AS n FROM w) GROUP BY doc_id, keyword),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, keyword) AS rank FROM c) SELECT doc_id, keyword, count, round(count / n::DOUBLE * 100, 2) AS density_pct, rank::INT AS rank FROM r WHERE rank <= 10""")
def keyword_density(spark, d):
    return X.keyword_density(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("readability", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+') AS t, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^\\s\\x{0085}\\x{000b}\\x{001c}-\\x{001f}\\p{Z}]'))) AS s FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, len(t) AS n, s, list_sum(list_transform(t, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x) LIKE '%e' AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM w)
SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / s) - 84.6::DOUBLE * (y::DOUBLE / n), 1) END AS ease FROM v""")
def readability(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.reading_ease(F.col("text")).alias("ease"))


@query("near_duplicates_exact")
def near_duplicates_exact(spark, d):
    """Documents of at least 0.85 Jaccard similarity over runs of five words; tested against brute force."""
    return similarity.exact_pairs(table(spark, d, "documents"), "doc_id", "text")


@query("near_duplicates_minhash")
def near_duplicates_minhash(spark, d):
    """The same by MinHash and bands; recall is tested against the exact pairs."""
    return similarity.near_duplicates(table(spark, d, "documents"), "doc_id", "text", way="minhash")


@query("stored_signature_pairs")
def stored_signature_pairs(spark, d):
    """Pages whose stored signatures agree in at least 0.85 of the positions."""
    return similarity.lsh_pairs(table(spark, d, "signatures").where("minhash is not null"), "url")


QUERIES = Q
