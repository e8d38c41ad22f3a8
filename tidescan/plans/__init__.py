"""Registered queries and their oracle SQL, collected from the modules of this package."""

from __future__ import annotations

import importlib

MODULES = ["tables", "code", "deps", "findings", "taint"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
