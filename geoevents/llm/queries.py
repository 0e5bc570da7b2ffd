"""The registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["toxicity", "secrets", "decontaminate", "bpe", "exact_dedup", "sharding", "licenses", "html_text", "quality", "near_dedup", "merkle", "token_counts", "spelling"]

for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES[_module.NAME] = _module.query
    if getattr(_module, "ORACLE", None):
        ORACLES[_module.NAME] = _module.ORACLE
