"""Every registered query of the layout engine, with its SQL twin."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("knn", "vectors", "layouts", "workload", "predicates", "transforms", "variants", "sweeps", "reports", "files", "streams")


def _modules():
    return [importlib.import_module(f"pageloom.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _modules() for name, text in module.ORACLES.items()}
