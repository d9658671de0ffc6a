"""Every named query with its SQL oracle, collected from the catalogue modules."""

from __future__ import annotations

import importlib
import pkgutil

from keepwell.plans import catalogue


def _all() -> dict:
    found = {}
    for info in pkgutil.iter_modules(catalogue.__path__):
        module = importlib.import_module(f"{catalogue.__name__}.{info.name}")
        for name, pair in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found


def queries() -> dict:
    return {name: pair[0] for name, pair in _all().items()}


def oracles() -> dict:
    return {name: pair[1] for name, pair in _all().items() if pair[1] is not None}
