"""Runnable queries over the driver's tables, with the SQL each one is checked against."""

from __future__ import annotations

import importlib
import pkgutil

from tidewire.plans import registry


def load():
    """Import every plan module once and return (queries, oracles)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
