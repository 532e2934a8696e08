"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

from tandemrank.catalog.registry import QUERIES, SQL

MODULES = ["ranking", "summaries", "resampling", "selection", "tensors", "pairing", "reports"]


def load():
    for name in MODULES:
        importlib.import_module(f"tandemrank.catalog.{name}")
    return QUERIES, SQL
