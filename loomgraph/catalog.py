"""Registered queries of the graph engine, with DuckDB equivalents."""

from __future__ import annotations

from .plans import derived, indexed, pages, stored, tables, work  # noqa: F401  all register with tables

QUERIES: dict = dict(tables.QUERIES)
ORACLES: dict[str, str] = dict(tables.ORACLES)
