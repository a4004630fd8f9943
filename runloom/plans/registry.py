"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("runs", "events", "grading", "text", "checks", "datasets", "sources", "cases")


def queries() -> dict:
    return {k: v for f in FAMILIES for k, v in import_module(f"runloom.plans.{f}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in import_module(f"runloom.plans.{f}").SQL.items()}
