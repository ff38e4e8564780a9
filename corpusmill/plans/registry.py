"""Collects the queries of all plan modules."""

from __future__ import annotations

import importlib

from corpusmill.plans.catalog import QUERIES, SQL, Query

MODULES: tuple[str, ...] = ("scalars", "dialogues", "reports", "search", "rules_and_cleaning", "pipelines")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"corpusmill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
