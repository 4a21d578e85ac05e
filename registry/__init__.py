"""Registered queries: each key maps to a Spark query and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    from registry import core

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"registry.{module}")
    return core.QUERIES, core.ORACLES
