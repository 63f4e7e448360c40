"""All registered queries, gathered from the catalog modules."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__ if "__path__" in globals() else
                 importlib.import_module("tidemark.plans").__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"tidemark.plans.{_m}")

QUERIES = registry.QUERIES
SQL = registry.SQL
