"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import panelforge.catalog as catalog
from panelforge.catalog.base import REGISTRY, Inputs
from panelforge.operators.ordered import bounded_by


def load() -> dict:
    for module in sorted(m.name for m in pkgutil.iter_modules(catalog.__path__)):
        if module not in ("base", "registry"):
            importlib.import_module(f"panelforge.catalog.{module}")
    return REGISTRY


def queries() -> dict:
    def bind(q):
        def run(spark, folder):
            inputs = Inputs(spark, folder)
            inputs.size_partitions()
            with bounded_by(lambda: inputs.sizes):
                return q.run(inputs)
        return run

    return {name: bind(q) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql}
