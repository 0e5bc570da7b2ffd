"""The event fact joined with its detail tables, tags and exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def tags_array(tags: DataFrame) -> DataFrame:
    """Sorted distinct tags per event."""
    return tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def attributes(kinds: dict[str, DataFrame], exposure: DataFrame | None = None) -> DataFrame:
    """One JSON object per event from its own detail table, merged with its exposure. Nulls are left out.

    An event has one category and so at most one detail row: the tables are stacked and joined once, instead of one
    left join per table.
    """
    stacked = []
    for category, table in kinds.items():
        fields = [c for c in table.columns if c not in ("id", "footprint")]
        stacked.append(table.select("id", F.lit(category).alias("kind"), F.to_json(F.struct(*fields)).alias("detail")))
    out = reduce(DataFrame.unionByName, stacked)
    if exposure is None:
        return out
    fields = [c for c in exposure.columns if c != "id"]
    scored = exposure.select("id", F.to_json(F.struct(*fields)).alias("scored"))
    return out.join(scored, "id", "full")


def merge_objects(*parts: Column) -> Column:
    """JSON objects with distinct keys as one object; null parts count as empty."""
    inner = [X.blank_to_null(F.regexp_replace(p, r"^\{|\}$", "")) for p in parts]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def star_read(events: DataFrame, kinds: dict[str, DataFrame], exposure: DataFrame, tags: DataFrame) -> DataFrame:
    """Every event with tags and attributes. All joins are on the event id, so the fact is shuffled once."""
    detail = attributes(kinds, exposure)
    wide = events.join(detail, "id", "left").join(tags_array(tags), "id", "left")
    own = F.when(F.col("kind") == F.col("layer_id"), F.col("detail"))
    return wide.withColumn("attributes", merge_objects(own, F.col("scored"))).withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("kind", "detail", "scored")


def kind_view(events: DataFrame, table: DataFrame, category: str) -> DataFrame:
    """Events of one category with the columns of its detail table."""
    return events.filter(F.col("layer_id") == category).join(table, "id")


def register_kind_views(events: DataFrame, kinds: dict[str, DataFrame]) -> list[str]:
    """Temp views ``event_<category>`` for SQL users."""
    for category, table in kinds.items():
        kind_view(events, table, category).createOrReplaceTempView(f"event_{category}")
    return [f"event_{category}" for category in kinds]


def hazard_attrs(events: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Events with the measures their hazard is scored by: stacked detail tables, joined once."""
    wanted = ["magnitude", "max_frp", "max_wind_kmh", "alert_level"]
    types = {"magnitude": "double", "max_frp": "double", "max_wind_kmh": "double", "alert_level": "string"}
    parts = []
    for category in ("earthquake", "wildfire", "cyclone", "flood", "volcano"):
        table = kinds[category]
        cols = [(F.col(c) if c in table.columns else F.lit(None)).cast(types[c]).alias(c) for c in wanted]
        parts.append(table.select("id", F.lit(category).alias("kind"), *cols))
    measures = reduce(DataFrame.unionByName, parts)
    hazards = events.filter(F.col("layer_id").isin("earthquake", "wildfire", "cyclone", "flood", "volcano"))
    joined = hazards.join(measures.withColumnRenamed("kind", "layer_id"), ["id", "layer_id"], "left")
    return joined
