"""All queries of the library."""

from __future__ import annotations

from . import files, rows, tables

MODULES = (rows, tables, files)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.Q.sql.items()}
