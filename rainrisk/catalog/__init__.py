"""Queries over the driver's tables, each with the inventory ids it covers and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rain", "gauges", "risk", "ground", "fire", "network", "sequences", "analytics", "search", "sources")


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a builder ``(spark, sf_dir) -> DataFrame`` under its function name."""
    def add(fn):
        CATALOG[fn.__name__] = Query(fn.__name__, tuple(ids.split()), fn, sql)
        return fn

    return add


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return CATALOG
