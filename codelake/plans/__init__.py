"""Registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module once and return the registry."""
    from codelake.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry
