"""Detail tables of the kinds of events, and what a new feed refreshes in them.

Each feed that writes a kind has its own columns: some only set by the first row of an event, some replaced by every later one, some
replaced unless the new value is missing. A row goes through ``merge.upsert_partial`` with these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge

c = F.col


@dataclass(frozen=True)
class Kind:
    columns: dict[str, str]  # column: field of the feed's detail struct
    replace: tuple[str, ...]
    keep_if_null: tuple[str, ...] = ()


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# Columns of the kind tables and their refresh rules.
ALERT_COLUMNS = ("gdacs_event_id", "episode_id", "alert_level", "alert_score", "population", "glide")
QUAKE_COLUMNS = ("magnitude", "mag_type", "depth_km", "tsunami", "felt", "cdi", "mmi", "sig", "alert", "status", "place")
QUAKES = Kind(_same(*QUAKE_COLUMNS), QUAKE_COLUMNS)
ALERTS = {
    "earthquake": Kind(_same(*ALERT_COLUMNS, "magnitude"), ALERT_COLUMNS, ("magnitude",)),
    "cyclone": Kind(_same(*ALERT_COLUMNS, "max_wind_kmh") | {"storm_name": "name", "storm_class": "severity_text"}, ("alert_level", "alert_score", "population", "storm_name", "max_wind_kmh", "storm_class")),
    "flood": Kind(_same(*ALERT_COLUMNS, "flood_severity_score", "severity_text", "country", "iso3"), ("flood_severity_score", "severity_text", "alert_level", "alert_score")),
    "drought": Kind(_same(*ALERT_COLUMNS, "affected_area_km2", "country", "iso3"), ("affected_area_km2", "alert_level", "alert_score")),
    "volcano": Kind(_same(*ALERT_COLUMNS, "severity_text", "country", "iso3") | {"volcano_name": "name"}, ("volcano_name", "severity_text", "alert_level", "alert_score")),
    "wildfire": Kind(_same(*ALERT_COLUMNS, "burned_area_ha"), (*ALERT_COLUMNS, "burned_area_ha")),
}
FIRES = Kind(_same("hotspot_count", "max_frp", "mean_frp", "satellite", "confidence", "daynight"), ("hotspot_count", "max_frp", "mean_frp"))


def kind_rows(events: DataFrame, kind: Kind, category: str | None = None) -> DataFrame:
    """Rows of a kind table from events with a ``detail`` struct."""
    rows = events if category is None else events.filter(c("category") == category)
    return rows.select("event_id", *[c(f"detail.{field}").alias(name) for name, field in kind.columns.items()])


def refreshed(stored: DataFrame, incoming: DataFrame, kind: Kind, order: Column | None = None) -> DataFrame:
    """The kind table after a feed. Columns that the feed does not bring stay, and are null in rows that are new."""
    return merge.upsert_partial(stored, incoming, ["event_id"], list(kind.replace), list(kind.keep_if_null), order)


def tsunami_tags(quakes: DataFrame) -> DataFrame:
    """(event_id, tag, tag_kind) of the quakes that are flagged."""
    return quakes.filter("detail.tsunami").select("event_id", F.lit("tsunami").alias("tag"), F.lit("keyword").alias("tag_kind"))


def with_tags(stored: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag table with the tags it lacks."""
    return merge.insert_absent(stored, tags, ["event_id", "tag"])
