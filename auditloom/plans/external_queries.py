"""Queries of the operators over external data, with stand-in tables and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.operators import external
from auditloom.plans.audit_queries import _normal
from auditloom.sources.tables import table
from auditloom.streaming import events as streams

Q: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of session and folder under a name."""
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _checks(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("keyword_id"), F.when(F.col("event_type") == "error", "skipped").otherwise("ranked").alias("status"),
        F.when(F.col("event_type") != "view", F.floor(F.col("value")).cast("int")).alias("position"),
    )


_CHECKS = "c AS (SELECT event_id AS id, user_id AS keyword_id, CASE WHEN event_type = 'error' THEN 'skipped' ELSE 'ranked' END AS status, CASE WHEN event_type <> 'view' THEN floor(value)::INT END AS position FROM events)"


@query("rank_overview", f"""WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY id DESC) AS n FROM c WHERE status <> 'skipped'),
g AS (SELECT keyword_id, max(position) FILTER (n = 1) AS position, max(position) FILTER (n = 2) AS previous FROM r WHERE n <= 2 GROUP BY keyword_id) SELECT *, previous - position AS change FROM g""")
def rank_overview(spark, d):
    return external.rank_overview(_checks(spark, d))


@query("rank_alerts", f"""WITH {_CHECKS}, r AS (SELECT *, lag(id) OVER w AS pid, lag(position) OVER w AS old_position FROM c WHERE status <> 'skipped' WINDOW w AS (PARTITION BY keyword_id ORDER BY id)),
k AS (SELECT * FROM r WHERE pid IS NOT NULL)
SELECT id, keyword_id, 'lost' AS kind, old_position, position AS new_position FROM k WHERE old_position IS NOT NULL AND position IS NULL
UNION ALL SELECT id, keyword_id, 'drop', old_position, position FROM k WHERE position - old_position >= 3
UNION ALL SELECT id, keyword_id, 'left_top10', old_position, position FROM k WHERE old_position <= 10 AND (position IS NULL OR position > 10)
UNION ALL SELECT id, keyword_id, 'gain', old_position, position FROM k WHERE old_position - position >= 5""")
def rank_alerts(spark, d):
    return external.rank_alerts(_checks(spark, d), gain_threshold=5)


@query("previous_real_check", f"""WITH {_CHECKS}, p AS (SELECT id, keyword_id, status, position, last_value(CASE WHEN status <> 'skipped' THEN id END IGNORE NULLS) OVER (PARTITION BY keyword_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id FROM c)
SELECT p.*, c.position AS previous_position FROM p LEFT JOIN c ON c.id = p.previous_id""")
def previous_real_check(spark, d):
    return external.with_previous(_checks(spark, d)).select("id", "keyword_id", "status", "position", "previous_id", "previous_position")


def _ranked(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")  # noqa: E741
    return l.select(F.col("l_suppkey").cast("string").alias("domain"), F.col("l_partkey").cast("string").alias("keyword"), F.col("l_quantity").cast("int").alias("position"), (F.col("p_size") * 10).alias("search_volume"), F.col("p_size").alias("difficulty"))


@query("content_gap", """WITH r AS (SELECT l_suppkey AS domain, l_partkey::VARCHAR AS keyword, l_quantity::INT AS position, p_size * 10 AS search_volume, p_size AS difficulty FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT keyword, domain, min(position) AS position, min(search_volume) AS search_volume, min(difficulty) AS difficulty FROM r WHERE domain IN (2, 3, 4) AND position <= 20 AND keyword NOT IN (SELECT keyword FROM r WHERE domain = 1 AND position <= 100) GROUP BY 1, 2)
SELECT keyword, any_value(search_volume) AS search_volume, any_value(difficulty) AS difficulty, round(any_value(search_volume) * (100 - any_value(difficulty)) / 100.0, 1)::DOUBLE AS opportunity,
  max(position) FILTER (domain = 2) AS "2", max(position) FILTER (domain = 3) AS "3", max(position) FILTER (domain = 4) AS "4" FROM b GROUP BY keyword""")
def content_gap(spark, d):
    rivals = ["2", "3", "4"]
    return external.gap_table(external.content_gap(_ranked(spark, d), "1", rivals), rivals)


@query("link_gap", """WITH n AS (SELECT l_partkey AS source, l_suppkey AS target, count(*) AS n FROM lineitem WHERE l_suppkey IN (2, 3, 4, 5) AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) GROUP BY 1, 2)
SELECT source, count(*) AS rivals, string_agg(target || ':' || n, ',' ORDER BY target::VARCHAR) AS linked FROM n GROUP BY source""")
def link_gap(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").cast("string").alias("target"))
    g = external.link_gap(links, "1", ["2", "3", "4", "5"])
    return g.withColumn("linked", F.array_join(F.transform(F.array_sort(F.map_entries("linked")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


def _daily(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("date", F.to_date("ts"))
    return e.groupBy(F.col("event_type").alias("site"), "date").agg(
        F.sum((F.col("user_id") % 7 == 0).cast("long")).cast("double").alias("clicks"), F.count("*").cast("double").alias("impressions"), F.round(F.avg("value"), 4).alias("position")
    )


@query("kpi_28_rows", """WITH dd AS (SELECT event_type AS site, CAST(ts AS DATE) AS date, (count(*) FILTER (user_id % 7 = 0))::DOUBLE AS clicks, count(*)::DOUBLE AS impressions, round(avg(value), 4) AS position FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC) AS n FROM dd)
SELECT site, CASE WHEN n <= 28 THEN 'current' ELSE 'previous' END AS period, sum(clicks) AS clicks, sum(impressions) AS impressions, round(sum(clicks) / sum(impressions), 4) AS ctr, round(sum(position * impressions) / sum(impressions), 2) AS position FROM r WHERE n <= 56 GROUP BY 1, 2""")
def kpi_28_rows(spark, d):
    return external.period_kpis(_daily(spark, d), "site")


@query("search_join", f"""WITH s AS (SELECT {_normal('url')} AS k, sum(issue_count)::BIGINT AS impressions, sum(depth)::BIGINT AS clicks FROM audit_pages WHERE url IS NOT NULL GROUP BY 1)
SELECT DISTINCT p.url, s.clicks, s.impressions FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) p JOIN s ON s.k = {_normal('p.url')}""")
def search_join(spark, d):
    search = table(spark, d, "audit_pages").where("url is not null").select("url", F.col("issue_count").alias("impressions"), F.col("depth").alias("clicks"))
    crawled = table(spark, d, "pages").where("url is not null").select("url").distinct()
    return external.search_join(search, crawled)["pages"].select("url", "clicks", "impressions")


@query("broken_backlinks", f"""WITH l AS (SELECT {_normal('canonical')} AS k, regexp_replace(regexp_replace(lower(regexp_extract(trim(url, ' '), '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?', 2)), '^.*@', ''), ':\\d*$', '') AS host FROM pages WHERE canonical IS NOT NULL AND url IS NOT NULL),
h AS (SELECT k, count(*) AS links, count(DISTINCT host) AS hosts FROM l GROUP BY k), b AS (SELECT url, max(status) AS status FROM pages WHERE status >= 400 GROUP BY url)
SELECT url, status, links, hosts FROM b JOIN h ON h.k = {_normal('b.url')}""")
def broken_backlinks(spark, d):
    p = table(spark, d, "pages")
    links = p.where("canonical is not null and url is not null").select(F.col("url").alias("url_from"), F.col("canonical").alias("url_to"))
    bad = p.where("status >= 400").groupBy("url").agg(F.max("status").alias("status"))
    return external.broken_backlinks(links, bad)


BRANDS = [("crawl", 0, ["crawler", "sitemap"]), ("page", 1, ["home page", "landing page"]), ("form", 2, ["checkout form"])]


@query("brand_mentions", " UNION ALL ".join(
    "SELECT doc_id AS answer_id, '{0}' AS owner FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\w\\p{{L}}\\p{{N}}\\p{{M}}-])({1})($|[^\\w\\p{{L}}\\p{{N}}\\p{{M}}-])')".format(o, "|".join(t)) for o, _, t in BRANDS
))
def brand_mentions(spark, d):
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    return external.brand_mentions(answers, spark.createDataFrame(BRANDS, "owner string, ord int, terms array<string>")).select("answer_id", "owner")


@query("share_of_voice", "WITH m AS (" + " UNION ALL ".join(
    "SELECT doc_id, '{0}' AS owner FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\w\\p{{L}}\\p{{N}}\\p{{M}}-])({1})($|[^\\w\\p{{L}}\\p{{N}}\\p{{M}}-])')".format(o, "|".join(t)) for o, _, t in BRANDS
) + "), c AS (SELECT owner, count(DISTINCT doc_id) AS answers FROM m GROUP BY owner) SELECT owner, answers, round(answers / (sum(answers) OVER ())::DOUBLE, 3) AS share FROM c")
def share_of_voice(spark, d):
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    return external.share_of_voice(external.brand_mentions(answers, spark.createDataFrame(BRANDS, "owner string, ord int, terms array<string>")))


@query("vitals_ratings", """WITH v AS (SELECT page_id, response_time_ms AS lcp, depth / 20.0::DOUBLE AS cls, word_count / 3.0::DOUBLE AS tbt FROM (SELECT DISTINCT page_id, response_time_ms, depth, word_count FROM pages WHERE response_time_ms IS NULL OR NOT isnan(response_time_ms))),
r AS (SELECT page_id, CASE WHEN lcp <= 2500 THEN 0 WHEN lcp <= 4000 THEN 1 WHEN lcp > 4000 THEN 2 END AS a, CASE WHEN cls <= 0.1 THEN 0 WHEN cls <= 0.25 THEN 1 WHEN cls > 0.25 THEN 2 END AS b, CASE WHEN tbt <= 200 THEN 0 WHEN tbt <= 600 THEN 1 WHEN tbt > 600 THEN 2 END AS c FROM v)
SELECT page_id::VARCHAR AS url, CASE greatest(a, b, c) WHEN 0 THEN 'good' WHEN 1 THEN 'needs_improvement' WHEN 2 THEN 'poor' END AS rating FROM r""")
def vitals_ratings(spark, d):
    p = table(spark, d, "pages").select("page_id", "response_time_ms", "depth", "word_count").distinct().where("response_time_ms is null or not isnan(response_time_ms)")
    v = p.select(F.col("page_id").cast("string").alias("url"), F.lit("lab").alias("data_kind"), F.col("response_time_ms").alias("lcp"), F.lit(None).cast("double").alias("inp"), (F.col("depth") / 20).alias("cls"), (F.col("word_count") / 3).alias("tbt"))
    return external.vitals_ratings(v).select("url", "rating")


@query("heading_terms", """WITH w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(coalesce(h1, '')), '[a-z]{{3,}}')) AS term FROM pages)
SELECT term, count(*) AS pages FROM w WHERE term NOT IN ({0}) AND CASE WHEN length(term) > 3 AND term LIKE '%s' THEN substr(term, 1, length(term) - 1) ELSE term END <> 'garden' GROUP BY term ORDER BY pages DESC, term LIMIT 15""".format(", ".join(f"'{w}'" for w in external.HEADING_STOP_WORDS)))
def heading_terms(spark, d):
    p = table(spark, d, "pages").groupBy("page_id").agg(F.collect_set("h1").alias("h2")).select(F.col("page_id").alias("url"), "h2", F.lit(1).alias("word_count"), F.lit(1).alias("ref_domains"), F.array(F.lit("Page")).alias("schema_types"))
    return external.content_summary(p, "gardens")["terms"]


@query("event_totals", "SELECT user_id::VARCHAR AS session_id, event_type AS kind, count(*) AS events, epoch_us(max(ts)) AS last_at FROM events GROUP BY 1, 2")
def event_totals(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return streams.running_totals(e).withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


@query("project_domains", "SELECT DISTINCT start_url, regexp_replace(regexp_replace(lower(regexp_extract(start_url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '') AS domain FROM audits WHERE start_url IS NOT NULL")
def project_domains(spark, d):
    return table(spark, d, "audits").where("start_url is not null").select("start_url", U.project_domain(F.col("start_url")).alias("domain")).distinct()


QUERIES = Q
