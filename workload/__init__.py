"""The queries the driver runs: each module lists ``QUERIES = {name: (spark function, SQL or None)}``."""

from __future__ import annotations

import importlib

MODULES = ["graph_queries", "path_queries", "build_queries", "repair_queries", "change_queries", "wiki_queries", "extract_queries",
           "enrich_queries", "analyze_queries",
           "language_queries", "stream_queries", "pack_queries"]


def registry() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, pair in importlib.import_module(f"workload.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found
