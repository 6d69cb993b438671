"""Every registered query, gathered from the modules that define them."""

from __future__ import annotations

import importlib

from gridspark.plans.registry import ORACLES, QUERIES, Query

MODULES = (
    "reductions",
    "fields",
    "intervals",
    "scalars",
    "observations",
    "series",
    "grids",
    "corpus",
    "journal",
    "audits",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"gridspark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
