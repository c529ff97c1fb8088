"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import queries_compat, queries_jobs, queries_logs, queries_reports, queries_streams, queries_text

_MODULES = (queries_text, queries_logs, queries_compat, queries_jobs, queries_reports, queries_streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
