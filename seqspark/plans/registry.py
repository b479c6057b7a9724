"""Named queries over the driver tables and their SQL counterparts: ``{name: (function, sql or None)}``."""

from __future__ import annotations

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def load_all() -> dict:
    """Import every query module and return the registry."""
    import importlib
    import pkgutil

    import seqspark.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"seqspark.plans.{m.name}")
    return REGISTRY
