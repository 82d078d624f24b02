"""Registry of the core queries and their SQL twins."""

from __future__ import annotations

from strataloom.plans import catalog_queries, domain_queries, parse_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (catalog_queries, domain_queries, parse_queries, vector_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
