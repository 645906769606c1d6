"""All queries of the library by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from .plans import queries

QUERIES = {name: q.run for name, q in queries.ALL.items()}
ORACLE_SQL = {name: q.sql for name, q in queries.ALL.items() if q.sql}
