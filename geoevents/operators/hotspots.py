"""Fire detections to daily grid clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_cell

# Cluster rule.
CELL_DEGREES = 0.5
MIN_COUNT = 8
MIN_FRP = 20.0


def with_cell(hotspots: DataFrame) -> DataFrame:
    return (hotspots.withColumn("cell_lat", grid_cell(F.col("lat"), CELL_DEGREES))
            .withColumn("cell_lng", grid_cell(F.col("lng"), CELL_DEGREES))
            .withColumn("acq_date", F.col("acq_at").cast("date")))


def strongest(hotspots: DataFrame, cap: int) -> DataFrame:
    """The top detections by fire power (an optional feed-size rule, applied before clustering)."""
    return hotspots.orderBy(F.coalesce(F.col("frp"), F.lit(0.0)).desc(), "hotspot_id").limit(cap)


def cluster_id(date, lat, lng):
    one = lambda v: F.format_number(v, 1)
    plain = lambda v: F.regexp_replace(one(v), ",", "")
    return F.concat_ws(":", F.lit("firms-cluster"), F.date_format(date, "yyyy-MM-dd"), plain(lat), plain(lng))


def hotspot_clusters(hotspots: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per cell and day with enough detections or enough power.

    Every aggregate combines map-side, so a cell holding a large share of the rows costs one partial row per task.
    ``columns`` are taken from the strongest detection.
    """
    frp = F.coalesce(F.col("frp"), F.lit(0.0))
    lead = F.min_by(F.struct(*columns), F.struct((-frp).alias("neg"), F.col("hotspot_id"))).alias("lead") if columns else None
    aggregates = [F.count(F.lit(1)).alias("hotspot_count"), F.max(frp).alias("max_frp"), F.avg(frp).alias("mean_frp"),
                  F.max("acq_at").alias("occurred_at")] + ([lead] if columns else [])
    grouped = with_cell(hotspots).groupBy("cell_lat", "cell_lng", "acq_date").agg(*aggregates)
    kept = grouped.filter((F.col("hotspot_count") >= MIN_COUNT) | (F.col("max_frp") >= MIN_FRP))
    out = (kept.withColumn("event_id", cluster_id(F.col("acq_date"), F.col("cell_lat"), F.col("cell_lng")))
           .withColumn("significance", F.least(F.lit(100.0), F.col("max_frp"))))
    return out.select("*", "lead.*").drop("lead") if columns else out


def hotspot_members(hotspots: DataFrame, clusters: DataFrame) -> DataFrame:
    """Detections with the id of the cluster they belong to, if it was kept."""
    keys = ["cell_lat", "cell_lng", "acq_date"]
    return with_cell(hotspots).join(clusters.select(*keys, "event_id"), keys, "left")
