"""All queries of this package."""

from __future__ import annotations

import importlib

from tandemrank.llm.registry import QUERIES, SQL

MODULES = ["neighbours", "media", "jaccard", "lines", "mixing", "quality", "pieces", "language", "secrets", "sharding", "lexical", "variants", "archives"]


def load():
    for name in MODULES:
        importlib.import_module(f"tandemrank.llm.{name}")
    return QUERIES, SQL
