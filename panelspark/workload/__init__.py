"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("basics", "feature_work", "evaluation", "profiles", "construction", "bookkeeping", "accounting", "live")


def load():
    """(queries, oracle statements) of all workload modules."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .catalog import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
