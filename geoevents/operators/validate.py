"""Row rules: which rows break the event contract, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LAYERS

# Columns that may not be null.
REQUIRED = ["id", "source", "layer_id", "title", "occurred_at", "updated_at", "lng", "lat", "geo_precision", "geo_source", "significance"]


def rules(columns: list[str]) -> list[tuple[str, Column]]:
    """(path, broken) per rule, in the order they are reported; only for the columns at hand."""
    out = [(name, F.col(name).isNull()) for name in REQUIRED if name in columns]
    ranges = {"lng": (-180.0, 180.0), "lat": (-90.0, 90.0), "confidence": (0.0, 1.0)}
    out += [(name, ~F.col(name).between(low, high)) for name, (low, high) in ranges.items() if name in columns]
    if "layer_id" in columns:
        out.append(("layer_id", ~F.col("layer_id").isin(LAYERS)))
    for name in ("keywords", "entities"):
        if name in columns:
            out.append((name, F.exists(name, lambda t: t["text"].isNull() | t["type"].isNull())))
    return out


def violations(rows: DataFrame) -> DataFrame:
    """Rows with the sorted set of paths they break."""
    found = [F.when(F.coalesce(broken, F.lit(False)), F.lit(path)) for path, broken in rules(rows.columns)]
    return rows.withColumn("violations", F.array_distinct(F.array_compact(F.array(*found))))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows with their violations)."""
    checked = violations(rows)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def reject_batch(rows: DataFrame, key: str = "id") -> DataFrame:
    """The batch, if every row is good; otherwise an error naming the first bad row and path."""
    bad = violations(rows).filter(F.size("violations") > 0).orderBy(key).select(key, F.element_at("violations", 1).alias("path")).first()
    if bad is not None:
        raise ValueError(f"row {bad[key]} violates the contract at {bad['path']}")
    return rows


def source_health(batches: DataFrame, as_of: Column, stale_hours: int = 24) -> DataFrame:
    """Per source: last pull, number of events, and ok / dark / error. batches: source, pulled_at, failed, events."""
    last = batches.groupBy("source").agg(F.max("pulled_at").alias("last_pull"), F.max_by("failed", "pulled_at").alias("failed"), F.sum("events").alias("events"))
    fresh = F.col("last_pull") >= as_of - F.expr(f"INTERVAL {stale_hours} HOURS")
    status = F.when(F.col("failed"), F.lit("error")).when(fresh, F.lit("ok")).otherwise(F.lit("dark"))
    return last.select("source", "last_pull", "events", status.alias("status"))
