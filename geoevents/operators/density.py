"""Densities and spreads over the sphere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G

# Reach of the kernel in bandwidths, and saturation.
INFLUENCE = 4.0
SATURATION = 1.5


def segments(bandwidth: float) -> tuple[int, int]:
    """(columns, rows) of the vertex grid for a bandwidth in degrees."""
    width = math.ceil(360 / max(0.1, bandwidth / 3.5))
    return width, math.ceil(width / 2)


#: Vertices along the side of a tile, and points that one task adds to a tile at most.
TILE, TILE_POINTS = 64, 20_000


def density_field(points: DataFrame, group: str, bandwidth: float, tile: int = TILE, tile_points: int = TILE_POINTS) -> DataFrame:
    """Gaussian density on the vertices near the points, per group, scaled to its own maximum and saturated at 1.

    Input: group, lat, lng, weight. Vertices no point reaches have density 0 and do not appear. The vertices are cut into square tiles. A point goes to every tile that its circle touches, so a tile
    has all it needs (its halo) and adds the points up row by row in an array of its own; only sums of vertices leave the task. Tiles with many points are shared out among several tasks.
    """
    width, height = segments(bandwidth)
    row_step, col_step, reach = 180.0 / height, 360.0 / width, INFLUENCE * bandwidth
    edge = math.radians(reach)
    # Equal points count once with their summed weight.
    merged = points.filter("weight <> 0").groupBy(group, "lat", "lng").agg(F.sum("weight").cast("double").alias("weight"))
    first = F.greatest(F.lit(0), F.floor((90.0 - F.col("lat") - reach) / row_step)).cast("int")
    last = F.least(F.lit(height), F.ceil((90.0 - F.col("lat") + reach) / row_step)).cast("int")
    # A circle reaches furthest in longitude beside its own latitude; near a pole it spans all of them.
    polar = (F.abs("lat") + reach) >= 90.0
    half = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("lat"))))))
    west = F.floor((F.col("lng") + 180.0 - half) / col_step).cast("int")
    east = F.ceil((F.col("lng") + 180.0 + half) / col_step).cast("int")
    columns = F.array_distinct(F.transform(F.sequence(west, east), lambda c: F.floor(F.pmod(c, F.lit(width)) / tile).cast("int")))
    placed = merged.withColumn("first", first).withColumn("last", last).withColumn("tile_col", F.explode(columns))
    placed = placed.withColumn("tile_row", F.explode(F.sequence(F.floor(F.col("first") / tile).cast("int"), F.floor(F.col("last") / tile).cast("int"))))
    keys = [group, "tile_row", "tile_col"]
    # At most one row per group and tile.
    shares = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile_points).cast("int").alias("shares"))
    dealt = placed.join(shares, keys).withColumn("share", F.pmod(F.xxhash64("lat", "lng"), F.col("shares")).cast("int"))
    stream = dealt.select(*keys, "share", "lat", "lng", "weight", "first", "last").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "share").sortWithinPartitions(*keys, "share")
    kind = dict(points.dtypes)[group]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, held = None, None
        for batch in batches:
            type_ = batch.schema.field(group).type
            names = (*keys, "share", "lat", "lng", "weight", "first", "last")
            for key, lat, lng, weight, top, bottom in ((r[:4], *r[4:]) for r in zip(*(batch.column(n).to_pylist() for n in names))):
                if key != held:
                    if held is not None:
                        yield sums(held, type_, total, touched)
                    held, total, touched = key, np.zeros((tile, tile)), np.zeros((tile, tile), dtype=bool)
                    start = held[1] * tile
                    lat_of = 90.0 - (start + np.arange(tile)) * row_step
                    lng_of = (held[2] * tile + np.arange(tile)) * col_step - 180.0
                    # Vertices beyond the last column are not there.
                    there = held[2] * tile + np.arange(tile) < width
                rows = slice(max(0, top - start), min(tile, bottom + 1 - start))
                beside = np.sin(np.radians(lng_of - lng) / 2) ** 2
                angle = np.sin(np.radians(lat_of[rows, None] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(lat_of[rows, None])) * beside[None, :]
                angle = 2 * np.arcsin(np.minimum(1.0, np.sqrt(angle)))
                # At the very edge the last bit decides, so these few are worked out one by one.
                for r, c in zip(*np.nonzero(np.abs(angle - edge) < 1e-9)):
                    angle[r, c] = one_angle(lat, lng, float(lat_of[rows][r]), float(lng_of[c]))
                near = (angle < edge) & there
                total[rows] += np.where(near, weight * np.exp(-((angle / math.radians(bandwidth)) ** 2) / 2), 0.0)
                touched[rows] |= near
        if held is not None:
            yield sums(held, type_, total, touched)

    def one_angle(lat: float, lng: float, lat_to: float, lng_to: float) -> float:
        up, beside = math.sin(math.radians(lat_to - lat) / 2), math.sin(math.radians(lng_to - lng) / 2)
        return 2 * math.asin(min(1.0, math.sqrt(up * up + math.cos(math.radians(lat)) * math.cos(math.radians(lat_to)) * (beside * beside))))

    def sums(key: tuple, type_: pa.DataType, total: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(touched)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(r), type_), pa.array(r + key[1] * tile, pa.int32()), pa.array(c + key[2] * tile, pa.int32()), pa.array(total[r, c])], names=[group, "row", "col", "part"])

    # At the poles all columns are one place; the grid keeps them apart, as a mesh does.
    raw = stream.mapInArrow(add_up, f"`{group}` {kind}, row int, col int, part double").groupBy(group, "row", "col").agg(F.sum("part").alias("raw"))
    # One row per group.
    peak = raw.groupBy(group).agg(F.max("raw").alias("peak"))
    return raw.join(peak, group).withColumn("density", F.least(F.lit(1.0), F.col("raw") * SATURATION / F.col("peak")))


def cell_time_density(points: DataFrame, step: float = 1.0, bucket: str = "1 day") -> DataFrame:
    """Weight and count per grid cell and UTC time bucket."""
    cells = points.withColumn("cell_lat", G.grid_cell(F.col("lat"), step)).withColumn("cell_lng", G.grid_cell(F.col("lng"), step))
    grouped = cells.groupBy(F.window("ts", bucket), "cell_lat", "cell_lng").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "cell_lat", "cell_lng", "weight", "n")


def angular_spread(points: DataFrame, group: str) -> DataFrame:
    """Spherical centre of each group and the largest angle from it, in degrees."""
    x, y, z = G.unit_vector(F.col("lat"), F.col("lng"))
    sums = points.groupBy(group).agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    center = sums.select(group, *[(F.col(c) / scale).alias(c) for c in ("x", "y", "z")])
    cosine = x * F.col("x") + y * F.col("y") + z * F.col("z")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    widest = points.join(center, group).groupBy(group).agg(F.max(angle).alias("angle"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z")))))
    return widest.select(group, lat.alias("center_lat"), F.degrees(F.atan2("y", "x")).alias("center_lng"), "angle")
