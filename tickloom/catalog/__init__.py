"""Registered queries, each with the SQL that states its expected result."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Queries and their SQL, by name."""
    from tickloom.catalog import base

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(base.QUERIES), dict(base.ORACLES)
