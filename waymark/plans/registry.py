"""All registered queries and their SQL statements."""

from __future__ import annotations

import importlib

from waymark.session import tune

MODULES = ["match_queries", "journey_queries", "site_queries", "page_queries", "stream_queries"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(importlib.import_module(f"waymark.plans.{module}"), attribute))
    return out


def _tuned(fn):
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)
    run.__name__ = fn.__name__
    return run


def queries() -> dict:
    return {name: _tuned(fn) for name, fn in _collect("QUERIES").items()}


def oracles() -> dict:
    return _collect("ORACLES")
