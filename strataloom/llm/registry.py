"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from strataloom.llm import copies_queries, encode_queries, neighbours_queries, packing_queries, pii_queries, quality_queries, splitting_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (copies_queries, encode_queries, neighbours_queries, packing_queries, pii_queries, quality_queries, splitting_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
