"""Registered queries over the star-schema test tables, each with a SQL twin."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

_MODULES = (
    "metric_queries", "clean_queries", "mutation_queries", "scoring_queries", "split_queries", "report_queries", "record_queries",
)


def load_all() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES
