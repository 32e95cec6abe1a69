"""Registered queries of the curation and embedding operators, each with its SQL where SQL has it."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("relational", "trees", "vectors", "states", "exchange", "loading")


def load() -> tuple[dict, dict]:
    """Queries and SQL of all topics."""
    found, sql = {}, {}
    for topic in TOPICS:
        module = import_module(f"quern.plans.{topic}")
        found.update(module.QUERIES)
        sql.update(module.ORACLE_SQL)
    return found, sql
