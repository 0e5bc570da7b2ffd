"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, scratch_path

#: Rows of either side and pairs that a task of a split join has at most.
HOT_ROWS, WORK = 20_000, 4_000_000


def rectangles(probe: DataFrame, build: DataFrame, keys: list[str], rows: int = HOT_ROWS, work: int = WORK) -> DataFrame:
    """(keys, probe_splits, build_splits) of the keys whose pairs are too many for one task, from counts of both sides.

    The pairs of a key are a rectangle, probe rows by build rows. It is cut into blocks of at most ``work`` pairs and ``rows`` rows a side, nearly square where both sides are
    long: that way the fewest rows are copied. A row goes to one stripe of its own side and is copied once per stripe of the other.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(probe, "p").join(count(build, "b"), keys)
    side = float(work) ** 0.5
    # The longest stripe that the other side's stripe leaves room for.
    stripe = lambda other: F.least(F.lit(float(rows)), F.lit(float(work)) / F.least(F.col(other), F.lit(side)))
    cut_ = both.select(*keys, F.ceil(F.col("p") / stripe("b")).cast("int").alias("probe_splits"), F.ceil(F.col("b") / stripe("p")).cast("int").alias("build_splits"))
    return cut_.filter("probe_splits > 1 or build_splits > 1")


def block_join(probe: DataFrame, build: DataFrame, keys: list[str], spread: str, probe_spread: str, rows_per_split: int = HOT_ROWS, work: int = WORK) -> DataFrame:
    """Inner join on ``keys`` where the pairs of a hot key are dealt out in blocks, see ``rectangles``.

    Rows are dealt to their stripes by a hash of ``spread`` and ``probe_spread``; each pair meets exactly once. Keys that are not hot have one block, so nothing
    is copied for them. The table of hot keys is written first: its size decides whether Spark broadcasts it.
    """
    path = scratch_path(probe.sparkSession, "hot-keys")
    rectangles(probe, build, keys, rows_per_split, work).write.parquet(path)
    hot = probe.sparkSession.read.parquet(path)
    if hot.isEmpty():
        return probe.join(build, keys)
    return dealt(probe, hot, keys, probe_spread, "probe", "build").join(dealt(build, hot, keys, spread, "build", "probe"), [*keys, "_probe_stripe", "_build_stripe"]).drop("_probe_stripe", "_build_stripe")


def stripes(probe: DataFrame, build: DataFrame, keys: list[str], spread: str, probe_spread: str, rows_per_split: int, work: int, probe_whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with their block, ``_probe_stripe`` and ``_build_stripe``: each pair of a key meets in exactly one block, see ``rectangles``. ``_whole``: the key has one block.

    ``probe_whole``: only the build side is cut, into as many stripes as there would be blocks, so a build row meets all its probe rows in one block.
    """
    path = scratch_path(probe.sparkSession, "hot-keys")
    cut_ = rectangles(probe, build, keys, rows_per_split, work)
    if probe_whole:
        cut_ = cut_.select(*keys, F.lit(1).alias("probe_splits"), (F.col("probe_splits") * F.col("build_splits")).alias("build_splits"))
    cut_.write.parquet(path)
    hot = probe.sparkSession.read.parquet(path)
    if hot.isEmpty():
        whole = {"_probe_stripe": F.lit(0), "_build_stripe": F.lit(0), "_whole": F.lit(True)}
        return probe.withColumns(whole), build.withColumns(whole)
    return dealt(probe, hot, keys, probe_spread, "probe", "build", "_whole"), dealt(build, hot, keys, spread, "build", "probe", "_whole")


def dealt(df: DataFrame, hot: DataFrame, keys: list[str], spread: str, own: str, other: str, whole: str | None = None) -> DataFrame:
    """Rows with the stripe of their own side, once for every stripe of the other side; column ``whole`` says that their key is not cut."""
    splits = lambda side: F.coalesce(F.col(f"{side}_splits"), F.lit(1))
    placed = df.join(hot, keys, "left").withColumn(f"_{own}_stripe", F.pmod(F.xxhash64(spread), splits(own)).cast("int"))
    if whole:
        placed = placed.withColumn(whole, F.col("probe_splits").isNull())
    return placed.withColumn(f"_{other}_stripe", F.explode(F.sequence(F.lit(0), splits(other) - 1))).drop("probe_splits", "build_splits")


def running_count(df: DataFrame, order: list[Column], counted: Column | None = None, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """1-based count of ``counted`` rows up to each row in a total order, without bringing a group to one task.

    The rows are range-partitioned on the whole order and written to reliable storage, so the ranges stay fixed; each range
    is numbered on its own and shifted by the sizes of the ranges before it (one small row per range).
    """
    counted = F.lit(True) if counted is None else counted
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()))
    one = counted.cast("bigint")
    sizes = ranged.groupBy("_range").agg(F.sum(one).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most ``partitions`` rows.
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumn(name, F.sum(one).over(local)).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """row_number() per key for keys of any size."""
    placed = running_count(df, [*[F.col(k) for k in keys], *order], name="_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")
