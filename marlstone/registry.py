"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from marlstone import plans
from marlstone.operators.registering import ORACLE_SQL, QUERIES

for module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"marlstone.plans.{module.name}")

FLAGSHIP = "list_filtered_flagship"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
