"""All registered queries of the interval operators and their DuckDB SQL.

Each of ``MODULES`` holds ``QUERIES``: name to (query, sql); sql
is None where SQL cannot express the operator."""

from __future__ import annotations

from importlib import import_module

MODULES = ["plans.core", "plans.telemetry", "plans.ingest", "plans.facts", "plans.episodes", "plans.consumption", "plans.observations", "plans.scalars", "plans.fits", "plans.operations", "plans.hot", "plans.evidence", "streaming.telemetry", "streaming.state", "streaming.upsert"]


def _all() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, pair in import_module(f"spanwise.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"{name} is registered twice")
            found[name] = pair
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
