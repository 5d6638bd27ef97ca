"""All registered queries and the SQL that states their results."""

from __future__ import annotations

from notespark.plans import (
    reports_facts,
    reports_feeds,
    reports_graph,
    reports_search,
    reports_sessions,
    reports_stored,
)

MODULES = [reports_search, reports_graph, reports_facts, reports_sessions, reports_feeds, reports_stored]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
