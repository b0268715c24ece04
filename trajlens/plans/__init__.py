"""Registered queries, one module per operator family."""

import importlib
import pkgutil

from trajlens.plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
