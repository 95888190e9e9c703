"""All queries of the core, with their SQL."""

from __future__ import annotations

from siftmill.plans import retrieval, reviewing, screening, sql

QUERIES = screening.QUERIES | retrieval.QUERIES | reviewing.QUERIES
SQL = sql.SQL | reviewing.SQL
FLAGSHIP = "bm25_ranking_metrics"
