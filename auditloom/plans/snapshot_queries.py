"""Queries over audit snapshots."""

from __future__ import annotations

from auditloom.operators.snapshots import audit_changes
from auditloom.sources.tables import table


def p1_found(spark, d):
    return audit_changes(table(spark, d, "audits"), table(spark, d, "audit_pages"), table(spark, d, "audit_issues"))


P1_SQL = """
WITH a AS (SELECT DISTINCT id, project_id, finished_at FROM audits WHERE status = 'completed'),
pairs AS (
  SELECT * FROM (
    SELECT id AS audit_id, lag(id) OVER (PARTITION BY project_id ORDER BY finished_at NULLS FIRST, id) AS previous_id FROM a)
  WHERE previous_id IS NOT NULL),
p AS (
  SELECT audit_id, url, title, status FROM (
    SELECT *, row_number() OVER (PARTITION BY audit_id, url ORDER BY id DESC) AS n FROM audit_pages) WHERE n = 1),
np AS (SELECT pairs.audit_id, url, title, status FROM p JOIN pairs ON p.audit_id = pairs.audit_id),
op AS (SELECT pairs.audit_id, url, title, status FROM p JOIN pairs ON p.audit_id = pairs.previous_id),
ni AS (SELECT DISTINCT pairs.audit_id, url, code FROM audit_issues i JOIN pairs ON i.audit_id = pairs.audit_id),
oi AS (SELECT DISTINCT pairs.audit_id, url, code FROM audit_issues i JOIN pairs ON i.audit_id = pairs.previous_id)
SELECT np.audit_id, 'page' AS record_kind, np.url, '' AS code,
       CASE WHEN op.audit_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM np LEFT JOIN op ON np.audit_id = op.audit_id AND np.url IS NOT DISTINCT FROM op.url
WHERE op.audit_id IS NULL OR np.title IS DISTINCT FROM op.title OR np.status IS DISTINCT FROM op.status
UNION ALL
SELECT op.audit_id, 'page', op.url, '', 'removed' FROM op
WHERE NOT EXISTS (SELECT 1 FROM np WHERE np.audit_id = op.audit_id AND np.url IS NOT DISTINCT FROM op.url)
UNION ALL
SELECT audit_id, 'issue', url, code, 'added' FROM (SELECT * FROM ni EXCEPT SELECT * FROM oi)
UNION ALL
SELECT audit_id, 'issue', url, code, 'removed' FROM (SELECT * FROM oi EXCEPT SELECT * FROM ni)
"""

QUERIES = {"p1_found": (p1_found, P1_SQL)}
