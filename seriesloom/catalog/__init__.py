"""Registered queries."""

from __future__ import annotations

from functools import cache
from importlib import import_module

from .views import Registry

MODULES = ("features", "tables", "runs", "evaluation", "sinks")


@cache
def registry() -> Registry:
    out = Registry()
    for name in MODULES:
        import_module(f".{name}", __name__).register(out)
    return out
