"""Collects the query modules."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("documents", "relational", "reviews", "context", "commands", "contents", "assembly", "navigation", "tables", "measures", "streams")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"docloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"docloom.plans.{name}").ORACLE_SQL
    return found
