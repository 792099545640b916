"""The queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "handwritten", "neighbours", "syntax_check", "docpairs", "neardup", "splitting", "encoding", "leakage", "mojibake")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    try:
        _module = import_module(f"loomdex.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"loomdex.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
