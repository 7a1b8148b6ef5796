"""Composed plans: the sensor view of the given tables and the registered queries over it."""

import importlib
import pkgutil


def all_queries():
    """Import every ``queries_*`` module and return the filled catalog."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.catalog")
