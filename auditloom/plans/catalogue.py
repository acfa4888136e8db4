"""All queries of the core library."""

from __future__ import annotations

from auditloom.plans import audit_queries, external_queries, more_queries, snapshot_queries


def registered() -> dict:
    """name -> (callable, SQL text or None)."""
    return {**snapshot_queries.QUERIES, **audit_queries.QUERIES, **external_queries.QUERIES, **more_queries.QUERIES}
