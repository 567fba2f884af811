"""DuckDB SQL for the registered queries, written independently of the jobs."""

from __future__ import annotations

import importlib

FAMILIES = ["core", "economics", "evaluation", "graph", "streams"]


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"oracles.{family}").ORACLES)
    return found
