"""Queries over records and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.llm.components import address_groups
from auditloom.llm.copies import collapse_copies
from auditloom.llm.neardup import page_classes, page_pairs
from auditloom.llm.percentiles import exact_percentiles, page_parts
from auditloom.sources.tables import table


def _copies(spark, d):
    return collapse_copies(table(spark, d, "pages"), "page_id", "audit_id", ["url", "final_url", "canonical"])


def p2_found(spark, d):
    return _copies(spark, d).where("id > first_id").select(
        F.col("first_id").alias("first_page_id"), F.col("id").alias("page_id")
    ).distinct()


def p2_copies(spark, d):
    """One row for each distinct record, with the number of its copies, itself included."""
    return _copies(spark, d).where("id = first_id").select(F.col("id").alias("page_id"), "copies").distinct()


_BARE = "regexp_replace(lower({0}), '[\\p{{Z}}\\p{{C}}\\p{{P}}\\p{{S}}\\s]+', '', 'g')"


def _canonical(c: str) -> str:
    base = _BARE.format(f"split_part({c}, '?', 1)")
    rest = f"CASE WHEN instr({c}, '?') > 0 THEN substr({c}, instr({c}, '?') + 1) ELSE '' END"
    return (
        f"{base} || array_to_string(list_sort(list_transform(regexp_split_to_array({rest}, '&'), "
        f"lambda x: {_BARE.format('x')})), '')"
    )


_P2 = f"""
WITH k AS (
  SELECT DISTINCT page_id, audit_id, {_canonical('url')} AS u, {_canonical('final_url')} AS f, {_canonical('canonical')} AS c
  FROM pages WHERE page_id IS NOT NULL AND audit_id IS NOT NULL),
g AS (SELECT page_id, min(page_id) OVER w AS first_page_id, count(*) OVER w AS copies FROM k
      WINDOW w AS (PARTITION BY audit_id, u, f, c))
"""


def p3_found(spark, d):
    groups = address_groups(table(spark, d, "pages"), "page_id", "audit_id", "url", ["alias_of", "duplicate_of"])
    return groups.select("group_id", F.col("id").alias("page_id")).distinct()


P3_SQL = """
WITH RECURSIVE e0 AS (
  SELECT audit_id, url AS a, alias_of AS b FROM pages WHERE alias_of IS NOT NULL AND url IS NOT NULL
  UNION SELECT audit_id, url, duplicate_of FROM pages WHERE duplicate_of IS NOT NULL AND url IS NOT NULL),
e AS (SELECT * FROM e0 UNION SELECT audit_id, b, a FROM e0),
reach AS (
  SELECT audit_id, a AS n, a AS m FROM e
  UNION SELECT r.audit_id, r.n, e.b FROM reach r JOIN e ON r.audit_id = e.audit_id AND r.m = e.a),
pairs AS (
  SELECT DISTINCT p.page_id, q.page_id AS other FROM reach r
  JOIN pages p ON p.audit_id = r.audit_id AND p.url = r.n JOIN pages q ON q.audit_id = r.audit_id AND q.url = r.m)
SELECT min(other) AS group_id, page_id FROM pairs GROUP BY page_id HAVING count(*) > 1
"""

def p4_percentiles(spark, d):
    return exact_percentiles(page_parts(table(spark, d, "pages"), table(spark, d, "audits")))


P4_SQL = """
WITH once AS (SELECT DISTINCT page_id, audit_id, fetched_at, response_time_ms, depth FROM pages),
proj AS (SELECT id, max(project_id) AS project_id FROM audits GROUP BY id),
j AS (SELECT o.*, p.project_id, strftime(o.fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM once o LEFT JOIN proj p ON p.id = o.audit_id),
m AS (SELECT *, 'response_time_ms' AS metric, response_time_ms AS v FROM j
      UNION ALL SELECT *, 'depth', CAST(depth AS DOUBLE) FROM j),
ok AS (SELECT * FROM m WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0),
g AS (SELECT 'audit' AS kind, CAST(audit_id AS VARCHAR) AS key, metric, v FROM ok
      UNION ALL SELECT 'project', CAST(project_id AS VARCHAR), metric, v FROM ok
      UNION ALL SELECT 'day', day, metric, v FROM ok
      UNION ALL SELECT 'overall', 'all', metric, v FROM ok),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, key, metric ORDER BY v) AS rn,
             count(*) OVER (PARTITION BY kind, key, metric) AS n FROM g WHERE key IS NOT NULL),
p AS (SELECT unnest([50, 90, 95, 99]) AS percentile)
SELECT kind, key, metric, percentile, v AS value, n, CAST(0 AS BIGINT) AS rank_error
FROM r, p WHERE rn = (n * percentile + 99) // 100
"""

def p5_found(spark, d):
    return page_pairs(table(spark, d, "page_cache"))


def p5_classes(spark, d):
    """One row for each page: its near-duplicate class, equal pages and links to other texts."""
    return page_classes(table(spark, d, "page_cache"))


QUERIES = {
    "p2_found": (p2_found, _P2 + "SELECT DISTINCT first_page_id, page_id FROM g WHERE page_id > first_page_id"),
    "p2_copies": (p2_copies, _P2 + "SELECT DISTINCT page_id, CAST(copies AS BIGINT) AS copies FROM g WHERE page_id = first_page_id"),
    "p3_found": (p3_found, P3_SQL),
    "p4_percentiles": (p4_percentiles, P4_SQL),
    "p5_found": (p5_found, None),
    "p5_classes": (p5_classes, None),
}
