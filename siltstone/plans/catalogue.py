"""All registered queries with their SQL."""

from __future__ import annotations

from siltstone.plans import oracle, queries, review, review_oracle

QUERIES = queries.QUERIES | review.QUERIES
SQL = oracle.SQL | review_oracle.SQL

__all__ = ["QUERIES", "SQL"]
