"""All registered queries."""

from __future__ import annotations

import importlib

from stockloom.catalog.registry import QUERIES, Query

MODULES = [
    "sources",
    "quality",
    "audits",
    "cleaning",
    "demand",
    "segments",
    "features",
    "trends",
    "forecasts",
    "anomalies",
    "inventory",
    "market",
    "messages",
    "streams",
]


def load() -> dict[str, Query]:
    """Import every catalogue module and return the queries by name."""
    for module in MODULES:
        importlib.import_module(f"stockloom.catalog.{module}")
    return QUERIES
