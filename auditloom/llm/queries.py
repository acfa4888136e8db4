"""Registered queries of this subpackage."""

from __future__ import annotations

from auditloom.llm import queries_algorithm, queries_text

QUERIES = {**queries_algorithm.QUERIES, **queries_text.QUERIES}
