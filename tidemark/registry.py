"""The registered queries of the library and the SQL each is held against."""

from __future__ import annotations

from tidemark.operators import audit, catalog, diffs, engine, feedback, graph, health, patterns, profile_modes, profiling, quality, retrieval, rules, snapshots, text
from tidemark.sources import catalog_files
from tidemark.streaming import alerts, collection

_MODULES = (audit, patterns, profiling, snapshots, graph, diffs, text, health, catalog, rules, retrieval, feedback, profile_modes, engine, quality, catalog_files, alerts, collection)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
