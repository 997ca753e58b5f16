"""Registered queries."""

from __future__ import annotations

import importlib

from screenloom.plans.registry import CHECKS, QUERIES, Query

GROUPS = ["screening", "similarity", "hiring", "learning", "models", "interviews", "reports", "streams"]


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"screenloom.plans.{group}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
