"""Operators for training-data pipelines. ``registry()`` gives their queries; nothing else in the library imports this."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

# Functions sent to executors carry this code along: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = [
    "packing", "html_text", "decontam", "url_filter", "token_count", "lm_score", "toxicity", "quality", "secrets_scan", "jaccard_join",
    "filter_audit", "warc", "prefix_trie",
]


def registry() -> dict:
    """``{query name: (function of spark and sf_dir, SQL or None)}`` of every module, and the whole pipeline."""
    found: dict = {}
    for module in MODULES:
        found.update(importlib.import_module(f"{__name__}.{module}").QUERIES)
    pipeline = importlib.import_module("corpus_pipeline")
    found["pipeline"] = (pipeline.run, pipeline.ORACLE_SQL)
    return found
