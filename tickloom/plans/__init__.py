"""All registered queries, one module per group of operators."""

from __future__ import annotations

import importlib
import pkgutil

from tickloom.plans import registry


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")


def all_builders():
    _load()
    return dict(registry.BUILDERS)


def all_oracles():
    _load()
    return dict(registry.ORACLES)
