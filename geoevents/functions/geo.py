"""Column expressions on the sphere and on grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in use (km); the exposure job uses the mean radius.
EARTH_KM = 6371.0
EARTH_MEAN_KM = 6371.0088
# Km per degree used for bounding boxes of exposure circles.
KM_PER_LAT = 110.574
KM_PER_LNG = 111.320
# Shift of the published 10-degree population tiles.
TILE_NORTH_SHIFT = 0.9004164601411873
TILE_WEST_SHIFT = 0.00791707992698
TILE_ROWS = 18
TILE_COLS = 36


def _d(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine_km(lat1, lng1, lat2, lng2, radius: float = EARTH_KM, wrap: bool = False) -> Column:
    """Great-circle distance. ``wrap`` folds the longitude difference into ±180° first."""
    lat1, lng1, lat2, lng2 = map(_d, (lat1, lng1, lat2, lng2))
    dlng = F.radians(lng2 - lng1)
    if wrap:
        dlng = F.pmod(dlng + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)
    half = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), F.lit(2.0)))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def angular_distance_deg(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle angle in degrees, from the dot product of unit vectors."""
    a, b = unit_vector(lat1, lng1), unit_vector(lat2, lng2)
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def unit_vector(lat, lng) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(_d(lat)), F.radians(_d(lng))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def wrap_lng(lng) -> Column:
    """Longitude folded into [-180, 180)."""
    return F.pmod(_d(lng) + 180.0, F.lit(360.0)) - 180.0


def grid_cell(value, step: float = 0.5) -> Column:
    """Nearest grid line, halves to even."""
    # Adding zero folds -0.0 into 0.0, so ids of the cell at the origin agree.
    return F.bround(_d(value) / step, 0) * F.lit(step) + F.lit(0.0)


def tile_row(lat) -> Column:
    lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), _d(lat)))
    row = F.floor((90.0 - TILE_NORTH_SHIFT - lat) / 10.0) + 1
    return F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), row)).cast("int")


def tile_col(lng) -> Column:
    col = F.floor((wrap_lng(lng) + 180.0 + TILE_WEST_SHIFT) / 10.0) + 1
    return F.least(F.lit(TILE_COLS), F.greatest(F.lit(1), col)).cast("int")


def tile_bounds(row: Column, col: Column) -> Column:
    """struct(west, south, east, north) of a published tile."""
    north = 90.0 - (row - 1) * 10.0 - TILE_NORTH_SHIFT
    west = -180.0 + (col - 1) * 10.0 - TILE_WEST_SHIFT
    return F.struct(west.alias("west"), (north - 10.0).alias("south"), (west + 10.0).alias("east"), north.alias("north"))


def circle_half_width(lat, radius_km) -> tuple[Column, Column]:
    """(degrees of latitude, degrees of longitude) reached by a circle."""
    radius_km = _d(radius_km)
    dlng = radius_km / (KM_PER_LNG * F.greatest(F.lit(0.01), F.cos(F.radians(_d(lat)))))
    return radius_km / KM_PER_LAT, dlng


def image_frame(lat: Column, lng: Column, radius_km: Column, width: int = 512) -> Column:
    """Bounding box at 1.5 radii and the pixel size of an image of it."""
    half = radius_km * 1.5
    dlat = half / 111.0
    dlng = F.least(F.lit(180.0), half / (111.0 * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))))
    clamp = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    south, north = clamp(lat - dlat, -90.0, 90.0), clamp(lat + dlat, -90.0, 90.0)
    west, east = clamp(lng - dlng, -180.0, 180.0), clamp(lng + dlng, -180.0, 180.0)
    ratio = F.floor(width * (north - south) / (east - west) + 0.5)
    height = F.least(F.lit(1024), F.greatest(F.lit(64), ratio)).cast("int")
    frame = F.struct(F.round(west, 4).alias("west"), F.round(south, 4).alias("south"), F.round(east, 4).alias("east"),
                     F.round(north, 4).alias("north"), F.lit(width).alias("width"), height.alias("height"))
    return F.when((north > south) & (east > west), frame)
