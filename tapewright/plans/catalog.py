"""All queries of the library, and their SQL, by name."""

from __future__ import annotations

from tapewright.plans import battery_queries, cross_queries, event_queries, registry_queries, series_queries, study_queries

_MODULES = (series_queries, cross_queries, event_queries, registry_queries, study_queries, battery_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
