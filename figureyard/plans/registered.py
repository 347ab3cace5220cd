"""Importing this module registers every query."""

import importlib
import pkgutil

from figureyard import plans
from figureyard.plans.catalog import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module not in ("catalog", "registered"):
        importlib.import_module(f"figureyard.plans.{_module}")

__all__ = ["QUERIES", "SQL"]
