"""Registered queries: each binds operators to the test tables and carries its DuckDB oracle."""

import importlib

from pairsim.plans.registry import ORACLE, QUERIES

_MODULES = ["vectors", "split", "evaluate", "ingest", "quality", "text", "outcomes", "streaming", "model", "training"]


def load_all():
    for m in _MODULES:
        importlib.import_module(f"pairsim.plans.{m}")
    return QUERIES, ORACLE
