"""The queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import importlib

MODULES = ["searching", "retrieval", "analytics", "texts", "collection", "lifecycle", "personas", "storing", "folders"]


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
