"""The catalogue of queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from citespark.plans import answering, evaluating, ingest, retrieval

PLANS = [retrieval, answering, ingest, evaluating]


def queries() -> dict:
    return {q.__name__: q for plan in PLANS for q in plan.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
