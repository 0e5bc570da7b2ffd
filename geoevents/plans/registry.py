"""Registry of named queries and of the SQL each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapter
from .adapter import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views)`` under ``name``. ``oracle`` is DuckDB SQL; ``{{view}}`` CTEs it uses are added in front."""
    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        MODULE[name] = fn.__module__.rsplit(".", 1)[-1]
        if oracle is not None:
            ORACLES[name] = adapter.with_views(oracle)
        return fn
    return add


PLANS = ["filters", "ranking", "star", "scalars", "pairs", "exposure", "country", "graph", "personal", "links", "maintenance", "feeds", "streams"]


def load() -> None:
    """Import every plan module, which fills the registry."""
    for name in PLANS:
        importlib.import_module(f"{__package__}.{name}")
