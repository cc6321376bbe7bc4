"""All registered queries, by name."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "scoring_queries", "state_queries", "source_queries", "watch_queries")


def all_queries() -> dict:
    found: dict = {}
    for module in MODULES:
        queries = importlib.import_module(f"feedloom.plans.{module}").QUERIES
        twice = set(found) & set(queries)
        if twice:
            raise ValueError(f"queries registered twice: {sorted(twice)}")
        found.update(queries)
    return found
