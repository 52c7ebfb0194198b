"""Registered queries by family, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from tracewright.plans import build_logs, graphs, layout, loads, logs, records, runs, stores, structures, tasks, usage, wide

FAMILIES = (tasks, graphs, logs, usage, structures, wide, build_logs, runs, layout, loads, records, stores)


def queries() -> dict:
    return {name: q for family in FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in FAMILIES for name, q in family.ORACLES.items()}
