"""Name -> (Spark query, oracle SQL, operator ids). Filled by the modules of ``plans``."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Fn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: Fn
    sql: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(ops: str, sql: str | None = None, name: str | None = None):
    """Register a query under its function name with the inventory ids it covers."""

    def wrap(fn: Fn) -> Fn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = Query(key, fn, sql, tuple(ops.split()))
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    from asofkit import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"asofkit.plans.{m.name}")
    return REGISTRY
