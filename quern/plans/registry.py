"""Collects the query modules of this package."""

from __future__ import annotations

import importlib

MODULES = ["snapshot_queries", "retrieval_queries", "text_queries", "store_queries", "log_queries", "pipeline_queries", "ingest_queries", "file_queries"]


def _modules():
    return [importlib.import_module(f"quern.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
