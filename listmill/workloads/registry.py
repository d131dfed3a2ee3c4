"""All queries and their SQL counterparts."""

from __future__ import annotations

from listmill.workloads import archive_queries, catalogue_queries, notice_queries

_MODULES = [archive_queries, notice_queries, catalogue_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
