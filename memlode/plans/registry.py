"""All queries of the engine and the DuckDB SQL that each must match."""

from __future__ import annotations

import importlib

FLAGSHIP = "bm25_top10"
MODULES = ("retrieval", "telemetry", "knowledge", "textual", "evaluation", "statistics", "maintenance", "selection", "sourced", "streams", "privacy", "inference", "lifecycle", "entities", "rounds", "routing")


def _all() -> list:
    return [importlib.import_module(f"memlode.plans.{m}").R for m in MODULES]


def queries() -> dict:
    return {k: f for r in _all() for k, f in r.queries.items()}


def oracle_sql() -> dict:
    return {k: s for r in _all() for k, s in r.sql.items()}
