"""Star reads and detail-table joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import star as op
from ..schema import KINDS
from .registry import query

# Derived detail columns per kind: (name, Spark/DuckDB expression over ev). Integers and texts only, so JSON text is the same everywhere.
DETAIL = {
    "earthquake": [("sig", "CAST(FLOOR(value) AS BIGINT)"), ("alert_level", "alert_level"), ("place", "location")],
    "wildfire": [("hotspot_count", "event_id % 40"), ("alert_level", "alert_level")],
    "cyclone": [("population", "event_id * 10"), ("alert_level", "alert_level")],
    "flood": [("country", "location"), ("alert_level", "alert_level")],
    "drought": [("affected_area_km2", "event_id * 3")],
    "volcano": [("severity_text", "title")],
    "conflict": [("fatalities", "event_id % 9"), ("location", "location")],
    "protest": [("crowd_size", "title")],
    "strategic_development": [("actor1", "title"), ("actor2", "country_iso3")],
}
TEXT = {"alert_level", "place", "country", "severity_text", "location", "crowd_size", "actor1", "actor2"}


def kind_tables(v) -> dict[str, DataFrame]:
    """One detail table per kind, for events whose key is not a multiple of 13 (those have no detail row)."""
    out = {}
    for kind in KINDS:
        rows = v.ev.filter((F.col("layer_id") == kind) & (F.col("event_id") % 13 != 0))
        out[kind] = rows.select("id", *[F.expr(expr).alias(name) for name, expr in DETAIL[kind]])
    return out


def _tags(v) -> DataFrame:
    return v.ev.select("id", F.explode(F.split("title", " ")).alias("tag"))


def _exposure(v) -> DataFrame:
    return v.ev.filter("event_id % 4 = 0").select("id", (F.col("event_id") * 7).alias("people_exposed"), F.lit("grid").alias("exposure_source"))


def _json(fields) -> str:
    parts = [f"""CASE WHEN ({expr}) IS NOT NULL THEN '"{name}":' || """ + (f"""'"' || ({expr}) || '"'""" if name in TEXT else f"CAST({expr} AS VARCHAR)") + " END" for name, expr in fields]
    return f"[{', '.join(parts)}]"


_OWN = "CASE " + " ".join(f"WHEN layer_id = '{k}' AND event_id % 13 <> 0 THEN {_json(f)}" for k, f in DETAIL.items()) + " ELSE [] END"
_ATTR = f"""'{{' || array_to_string(list_filter(list_concat({_OWN}, CASE WHEN event_id % 4 = 0 THEN ['"people_exposed":' || CAST(event_id*7 AS VARCHAR), '"exposure_source":"grid"'] ELSE [] END), lambda x: x IS NOT NULL), ',') || '}}'"""
_TAG_SQL = "array_to_string(list_sort(list_distinct(string_split(title, ' '))), ',')"


@query("star_read", f"SELECT id, layer_id, source, significance, {_TAG_SQL} AS tags, {_ATTR} AS attributes FROM ev")
def star_read(v):
    wide = op.star_read(v.ev, kind_tables(v), _exposure(v), _tags(v))
    return wide.select("id", "layer_id", "source", "significance", F.array_join("tags", ",").alias("tags"), "attributes")


_OWN_JSON = f"""CASE WHEN len({_OWN}) > 0 OR (event_id % 13 <> 0 AND layer_id IN ({', '.join(f"'{k}'" for k in KINDS)})) THEN '{{' || array_to_string(list_filter({_OWN}, lambda x: x IS NOT NULL), ',') || '}}' END"""


@query("attributes_object", f"SELECT id, {_OWN_JSON} AS detail, CASE WHEN event_id % 4 = 0 THEN '{{\"people_exposed\":' || CAST(event_id*7 AS VARCHAR) || ',\"exposure_source\":\"grid\"}}' END AS scored FROM ev WHERE {_OWN_JSON} IS NOT NULL OR event_id % 4 = 0")
def attributes_object(v):
    """Detail rows as JSON objects without nulls, beside the exposure of the event."""
    return op.attributes(kind_tables(v), _exposure(v)).select("id", "detail", "scored")


@query("kind_views", "SELECT layer_id, id, significance FROM ev WHERE event_id % 13 <> 0 AND layer_id IN (" + ", ".join(f"'{k}'" for k in KINDS) + ")")
def kind_views(v):
    tables = kind_tables(v)
    views = [op.kind_view(v.ev, t, k).select("layer_id", "id", "significance") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, views)


def hazard_tables(v) -> dict[str, DataFrame]:
    """Detail tables with the measures that hazards are scored by."""
    measure = {"earthquake": "magnitude", "wildfire": "max_frp", "cyclone": "max_wind_kmh"}
    out = {}
    for kind in ("earthquake", "wildfire", "cyclone", "flood", "volcano"):
        rows = v.ev.filter((F.col("layer_id") == kind) & (F.col("event_id") % 13 != 0))
        value = F.when(F.col("event_id") % 3 != 0, F.col("value") / {"earthquake": 60.0, "wildfire": 4.0, "cyclone": 2.0}.get(kind, 1.0))
        out[kind] = rows.select("id", *([value.alias(measure[kind])] if kind in measure else []), "alert_level")
    return out


HAZARD_ATTRS = """hz AS (SELECT id, event_id, layer_id, lat, lng, CASE WHEN layer_id='earthquake' AND event_id%3<>0 AND event_id%13<>0 THEN value/60.0 END AS magnitude,
  CASE WHEN layer_id='wildfire' AND event_id%3<>0 AND event_id%13<>0 THEN value/4.0 END AS max_frp, CASE WHEN layer_id='cyclone' AND event_id%3<>0 AND event_id%13<>0 THEN value/2.0 END AS max_wind_kmh,
  CASE WHEN event_id%13<>0 THEN alert_level END AS alert_level FROM ev WHERE layer_id IN ('earthquake','wildfire','cyclone','flood','volcano'))"""


@query("hazard_attrs", f"WITH {HAZARD_ATTRS} SELECT id, layer_id, ROUND(magnitude, 4) AS magnitude, ROUND(max_frp, 4) AS max_frp, ROUND(max_wind_kmh, 4) AS max_wind_kmh, alert_level FROM hz")
def hazard_attrs(v):
    rows = op.hazard_attrs(v.ev.drop("alert_level", "magnitude"), hazard_tables(v))
    return rows.select("id", "layer_id", *[F.round(c, 4).alias(c) for c in ("magnitude", "max_frp", "max_wind_kmh")], "alert_level")


@query("feed_publisher", "SELECT feed_url, publisher_id, name, country, status, error_count FROM feed JOIN publisher USING (publisher_id)")
def feed_publisher(v):
    return v.feed.join(v.publisher, "publisher_id").select("feed_url", "publisher_id", "name", "country", "status", "error_count")


@query("tags_array", f"SELECT id, {_TAG_SQL} AS tags FROM ev")
def tags_array(v):
    return op.tags_array(_tags(v)).select("id", F.array_join("tags", ",").alias("tags"))
