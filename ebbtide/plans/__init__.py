"""Registered queries over the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every module here and return the registry."""
    from ebbtide.plans.registry import REGISTRY

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return REGISTRY
