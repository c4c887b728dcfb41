"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from barloom.catalog.registry import ORACLES, QUERIES, Query

GROUPS = ["ingest", "check", "windows", "screen", "split", "measure", "contrast", "learn"]


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"barloom.catalog.{group}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
