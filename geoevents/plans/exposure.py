"""Population exposure and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as dn
from ..operators import exposure as op
from ..operators import star
from ..schema import layer_category
from .registry import query
from .scalars import INTENSITY_SQL
from .star import HAZARD_ATTRS, hazard_tables

RADIUS = "CASE layer_id WHEN 'earthquake' THEN 50.0 WHEN 'wildfire' THEN 25.0 WHEN 'flood' THEN 40.0 WHEN 'cyclone' THEN 80.0 WHEN 'volcano' THEN 30.0 END::DOUBLE"
HAZ = "layer_id IN ('earthquake','wildfire','cyclone','flood','volcano')"
TILES = f"""circ AS (SELECT id, lat, lng, {RADIUS} AS radius_km FROM ev WHERE {HAZ}),
  bx AS (SELECT *, lat - radius_km/110.574 AS s, lat + radius_km/110.574 AS n, lng - radius_km/(111.320*GREATEST(0.01, cos(radians(lat)))) AS w, lng + radius_km/(111.320*GREATEST(0.01, cos(radians(lat)))) AS e FROM circ),
  sp AS (SELECT id, s, n, CASE WHEN w < -180 THEN w + 360 ELSE w END AS w, CASE WHEN w < -180 OR e > 180 THEN 180.0 ELSE e END AS e FROM bx UNION ALL SELECT id, s, n, -180.0, CASE WHEN e > 180 THEN e - 360 ELSE e END FROM bx WHERE w < -180 OR e > 180),
  grid AS (SELECT r AS tile_row, c AS tile_col, 90.0-(r-1)*10-0.9004164601411873 AS tn, -180.0+(c-1)*10-0.00791707992698 AS tw FROM generate_series(1, 18) a(r), generate_series(1, 36) b(c)),
  tiles AS (SELECT DISTINCT id, tile_row, tile_col FROM sp JOIN grid ON tw < e AND tw + 10 > w AND tn - 10 < n AND tn > s)"""
# Tiles are published unless their row and column add up to a multiple of 7.
PEOPLE = f"""ppl AS (SELECT c.id, COALESCE(SUM(CASE WHEN p.pop >= 0 THEN p.pop END), 0) AS people FROM (SELECT id, lat, lng, {RADIUS} AS radius_km FROM ev WHERE {HAZ}) c LEFT JOIN pop_cell p
   ON p.lat BETWEEN c.lat - 0.8 AND c.lat + 0.8 AND 2*6371.0088*asin(LEAST(1.0, sqrt(pow(sin(radians(p.lat-c.lat)/2),2) + cos(radians(c.lat))*cos(radians(p.lat))*pow(sin(radians(p.lng-c.lng)/2),2)))) <= c.radius_km GROUP BY c.id)"""


def circles(v):
    e = v.ev.withColumn("radius_km", op.hazard_radius(F.col("layer_id"))).filter("radius_km is not null")
    return e.select("id", "layer_id", "lat", "lng", "radius_km")


def published_tiles(spark):
    """The published tiles: a constant list of at most 648."""
    grid = spark.range(18).select((F.col("id") + 1).cast("int").alias("tile_row")).withColumn("tile_col", F.explode(F.sequence(F.lit(1), F.lit(36))))
    return grid.filter((F.col("tile_row") + F.col("tile_col")) % 7 != 0)


@query("tiles_covering", f"WITH {TILES} SELECT id, tile_row, tile_col FROM tiles")
def tiles_covering(v):
    tiles = circles(v).select("id", F.inline(op.tiles_covering(F.col("lat"), F.col("lng"), F.col("radius_km"))))
    return tiles.select("id", F.col("tile_row").cast("bigint").alias("tile_row"), F.col("tile_col").cast("bigint").alias("tile_col"))


@query("tile_coverage", f"WITH {TILES} SELECT id, bool_and((tile_row + tile_col) % 7 <> 0) AS covered FROM tiles GROUP BY id")
def tile_coverage(v):
    c = circles(v)
    keys = ["lat", "lng", "radius_km"]
    return c.join(op.covered(op.places(c), published_tiles(v.spark)), keys).select("id", "covered")


@query("people_in_radius", f"WITH {PEOPLE} SELECT id, ROUND(people, 2) AS people FROM ppl")
def people_in_radius(v):
    c = circles(v)
    return c.join(op.people_in_radius(op.places(c), v.pop_cell), ["lat", "lng", "radius_km"]).select("id", F.round("people", 2).alias("people"))


@query("exposure_score", f"""WITH {TILES}, {PEOPLE}, {HAZARD_ATTRS}, lv AS (SELECT id, layer_id, {INTENSITY_SQL} AS intensity FROM hz),
  ok AS (SELECT id FROM tiles GROUP BY id HAVING bool_and((tile_row + tile_col) % 7 <> 0)),
  sc AS (SELECT id, people, intensity, 100.0*GREATEST(0, intensity)*GREATEST(0, LEAST(1.0, log10(people+1.0)/log10(5000000.0))) AS score FROM lv JOIN ok USING (id) JOIN ppl USING (id) WHERE intensity IS NOT NULL)
  SELECT id, CAST(round_even(people, 0) AS BIGINT) AS people_exposed, ROUND(intensity, 7)::DOUBLE AS intensity, ROUND(score, 4)::DOUBLE AS impact_score,
   CASE WHEN score < 25 THEN 'Low' WHEN score < 50 OR people < 500 THEN 'Moderate' WHEN score < 75 THEN 'High' ELSE 'Severe' END AS impact_class FROM sc""")
def exposure_score(v):
    hazards = star.hazard_attrs(v.ev.drop("alert_level", "magnitude"), hazard_tables(v)).withColumnRenamed("layer_id", "category")
    scored = op.exposure(hazards, v.pop_cell, published_tiles(v.spark))
    return scored.select("id", "people_exposed", F.round("intensity", 7).alias("intensity"), F.round("impact_score", 4).alias("impact_score"), "impact_class")


W, HGT = dn.segments(3.0)


@query("density_field", f"""WITH m AS (SELECT category, lat, lng, COUNT(*) AS weight FROM ev JOIN layer_category USING (layer_id) GROUP BY ALL),
  g AS (SELECT r, c, 90.0 - r*(180.0/{HGT}) AS vlat, c*(360.0/{W}) - 180 AS vlng FROM generate_series(0, {HGT}) a(r), generate_series(0, {W - 1}) b(c)),
  d AS (SELECT category, r, c, weight, 2*asin(LEAST(1.0, sqrt(pow(sin(radians(vlat-lat)/2),2) + cos(radians(lat))*cos(radians(vlat))*pow(sin(radians(vlng-lng)/2),2)))) AS angle FROM m JOIN g ON vlat BETWEEN lat-12 AND lat+12 AND (abs(lat) > 77 OR abs(vlng-lng) < 70 OR abs(vlng-lng) > 290)),
  raw AS (SELECT category, r, c, SUM(weight*exp(-pow(angle/radians(3.0),2)/2)) AS raw FROM d WHERE angle < radians(12.0) GROUP BY ALL)
  SELECT category, r AS grid_row, c AS grid_col, ROUND(LEAST(1.0, raw*1.5/MAX(raw) OVER (PARTITION BY category)), 5)::DOUBLE AS density FROM raw""")
def density_field(v):
    """Density of all events, per category."""
    markers = v.ev.select(layer_category(F.col("layer_id")).alias("category"), "lat", "lng", F.lit(1.0).alias("weight"))
    field = dn.density_field(markers, "category", 3.0)
    return field.select("category", F.col("row").cast("bigint").alias("grid_row"), F.col("col").cast("bigint").alias("grid_col"), F.round("density", 5).alias("density"))


@query("cell_time_density", "SELECT date_trunc('day', occurred_at) AS start, round_even(lat, 0) + CAST(0 AS DOUBLE) AS cell_lat, round_even(lng, 0) + CAST(0 AS DOUBLE) AS cell_lng, ROUND(SUM(value), 3) AS weight, COUNT(*) AS n FROM ev GROUP BY ALL")
def cell_time_density(v):
    points = v.ev.select("lat", "lng", F.col("value").alias("weight"), F.col("occurred_at").alias("ts"))
    return dn.cell_time_density(points).select(F.col("start").cast("timestamp_ntz").alias("start"), "cell_lat", "cell_lng", F.round("weight", 3).alias("weight"), "n")


@query("angular_spread", """WITH s AS (SELECT user_id, SUM(cos(radians(lat))*cos(radians(lng))) AS sx, SUM(cos(radians(lat))*sin(radians(lng))) AS sy, SUM(sin(radians(lat))) AS sz FROM ev GROUP BY user_id),
  c AS (SELECT user_id, sx/sqrt(sx*sx+sy*sy+sz*sz) AS x, sy/sqrt(sx*sx+sy*sy+sz*sz) AS y, sz/sqrt(sx*sx+sy*sy+sz*sz) AS z FROM s)
  SELECT user_id, ROUND(degrees(asin(LEAST(1, GREATEST(-1, z)))), 5) AS center_lat, ROUND(degrees(atan2(y, x)), 5) AS center_lng, ROUND(a, 5) AS angle FROM c
   JOIN (SELECT user_id, MAX(degrees(acos(LEAST(1, GREATEST(-1, cos(radians(lat))*cos(radians(lng))*x + cos(radians(lat))*sin(radians(lng))*y + sin(radians(lat))*z))))) AS a FROM ev JOIN c USING (user_id) GROUP BY user_id) USING (user_id)""")
def angular_spread(v):
    s = dn.angular_spread(v.ev.select("user_id", "lat", "lng"), "user_id")
    return s.select("user_id", *[F.round(c, 5).alias(c) for c in ("center_lat", "center_lng", "angle")])
