"""Unions and row de-duplication by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of sources with different columns; what a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def unseen(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return items.join(known.select(key), key, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, plus incoming ones with a new key."""
    return existing.unionByName(unseen(incoming, existing, key))


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key. An aggregation, so a key with very many rows is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("last")).select(*keys, "last.*")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values per key in order of first appearance."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("value")))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["value"]).alias("values"))
