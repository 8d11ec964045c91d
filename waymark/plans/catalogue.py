"""All queries of the core, by name."""

from __future__ import annotations

from waymark.plans import analyses, at_scale, auditing, details, numerics, records, reranking, retrieval, searches

MODULES = (retrieval, auditing, analyses, reranking, numerics, records, searches, details, at_scale)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
