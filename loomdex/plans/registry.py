"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar_queries", "index_queries", "search_queries", "catalog_queries", "listing_queries", "parse_queries")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"loomdex.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
