"""The registered queries and their oracle SQL, gathered from the query modules."""

from __future__ import annotations

from starfold.queries import QUERIES, SQL, Query, cohort, curves, labels, metrics, searches, sources, streams, studies


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
