"""People near hazards: population cells within a radius, and the impact that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import score as M
from ..schema import HAZARD_RADIUS_KM
from .pairs import home_cell, reached_cells
from .skew import block_join

EXPOSURE_SOURCE = "JRC GHSL GHS-POP R2023A"


def hazard_radius(category: Column) -> Column:
    radius = F.lit(None).cast("double")
    for name, km in HAZARD_RADIUS_KM.items():
        radius = F.when(category == name, F.lit(km)).otherwise(radius)
    return radius


def population_cells(cells: DataFrame) -> DataFrame:
    """Usable cells with their published tile; negative and non-finite values are no data."""
    usable = F.when(F.isnan("pop") | (F.col("pop") < 0) | (F.col("pop") == float("inf")), F.lit(0.0)).otherwise(F.coalesce("pop", F.lit(0.0)))
    return cells.withColumn("pop", usable).withColumn("tile_row", G.tile_row(F.col("lat"))).withColumn("tile_col", G.tile_col(F.col("lng")))


def tiles_covering(lat: Column, lng: Column, radius_km: Column) -> Column:
    """Array of struct(tile_row, tile_col) touched by the bounding box of a circle, on both sides of ±180°."""
    dlat, dlng = G.circle_half_width(lat, radius_km)
    south, north = F.greatest(F.lit(-90.0), lat - dlat), F.least(F.lit(90.0), lat + dlat)
    west, east = lng - dlng, lng + dlng
    top, left = 90.0 - G.TILE_NORTH_SHIFT, 180.0 + G.TILE_WEST_SHIFT

    def span(low: Column, high: Column, last: int) -> Column:
        low, high = F.greatest(low.cast("int"), F.lit(1)), F.least(high.cast("int"), F.lit(last))
        numbers = F.sequence(F.least(low, high), F.greatest(low, high))
        return F.when(low <= high, numbers).otherwise(F.array().cast("array<int>"))

    rows = span(F.floor((top - north) / 10.0) + 1, F.ceil((top - south) / 10.0), G.TILE_ROWS)
    cols = lambda a, b: span(F.floor((a + left) / 10.0) + 1, F.ceil((b + left) / 10.0), G.TILE_COLS)
    edge_w, edge_e = F.lit(-180.0), F.lit(180.0)
    columns = (F.when(west < -180.0, F.array_union(cols(west + 360.0, edge_e), cols(edge_w, east)))
               .when(east > 180.0, F.array_union(cols(west, edge_e), cols(edge_w, east - 360.0)))
               .otherwise(cols(west, east)))
    tile = lambda r: F.transform(columns, lambda c: F.struct(r.alias("tile_row"), c.alias("tile_col")))
    return F.flatten(F.transform(rows, tile))


def places(events: DataFrame) -> DataFrame:
    """Distinct circles: events piled on one point are worked out once."""
    return events.select("lat", "lng", "radius_km").distinct()


def people_in_radius(circles: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of the population of cells whose centre is inside each circle (0 if there is none).

    Circles visit the few grid cells they can reach; the population keeps its place. Sums combine map-side.
    """
    reach = max(HAZARD_RADIUS_KM.values())
    probe = reached_cells(circles, reach).withColumn("circle_key", F.xxhash64("lat", "lng", "radius_km"))
    build = home_cell(population_cells(cells).filter("pop > 0").select("pop", "lat", "lng"), reach).select(
        "band", "cell", "pop", F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng"), F.xxhash64("lat", "lng").alias("cell_key"))
    met = block_join(probe, build, ["band", "cell"], "cell_key", "circle_key")
    inside = G.haversine_km(F.col("lat"), F.col("lng"), F.col("cell_lat"), F.col("cell_lng"), G.EARTH_MEAN_KM, wrap=True) <= F.col("radius_km")
    keys = ["lat", "lng", "radius_km"]
    sums = met.filter(inside).groupBy(*keys).agg(F.sum("pop").alias("people"))
    return circles.join(sums, keys, "left").withColumn("people", F.coalesce("people", F.lit(0.0)))


def covered(circles: DataFrame, published: DataFrame) -> DataFrame:
    """Whether every tile a circle touches is published."""
    keys = ["lat", "lng", "radius_km"]
    needed = circles.withColumn("tile", F.explode(tiles_covering(F.col("lat"), F.col("lng"), F.col("radius_km")))).select(*keys, "tile.*")
    known = published.select("tile_row", "tile_col").distinct().withColumn("known", F.lit(True))
    checked = needed.join(known, ["tile_row", "tile_col"], "left")
    return checked.groupBy(*keys).agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("covered"))


def exposure(hazards: DataFrame, cells: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Scored hazards. Without a usable measure, or with an unpublished tile, a hazard has no score.

    Input: id, category, lat, lng, magnitude, max_frp, max_wind_kmh, alert_level.
    """
    level = M.hazard_intensity(F.col("category"), F.col("magnitude"), F.col("max_frp"), F.col("max_wind_kmh"), F.col("alert_level"))
    scored = hazards.withColumn("radius_km", hazard_radius(F.col("category"))).withColumn("intensity", level).filter(
        F.col("intensity").isNotNull() & F.col("radius_km").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    circles = places(scored)
    keys = ["lat", "lng", "radius_km"]
    if published is not None:
        scored = scored.join(covered(circles, published).filter("covered").select(*keys), keys, "left_semi")
    out = scored.join(people_in_radius(circles, cells), keys)
    score = M.impact_score(F.col("intensity"), F.col("people"))
    return (out.withColumn("people_exposed", F.greatest(F.lit(0), F.bround("people", 0).cast("bigint")))
            .withColumn("impact_score", score).withColumn("impact_class", M.impact_class(score, F.col("people")))
            .withColumn("exposure_source", F.lit(EXPOSURE_SOURCE)))
