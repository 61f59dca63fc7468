"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("relational", "profiling", "composites", "preparation", "modelling", "fixed_models")


def load():
    """The registry with every query module loaded."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
