"""What the operators share: tables in the shared folder, gapless numbering, Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Seconds per partition matter less than bounded memory: a task's share of compact rows, used to choose partition counts.
TEXT_COLUMNS = ("doc_id", "text")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` range-partitioned on a total order and saved, with its range number in ``_range``.

    Later steps number or sum inside the ranges and add small offsets per range, so no task sees more than a range.
    """
    return saved(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), label)


def numbered(df: DataFrame, group: str, order: list[Column], name: str, label: str) -> DataFrame:
    """0-based gapless number of each row within ``group``, for groups of any size; ``order`` must be total."""
    ranged = running(df, [F.col(group), *order], label)
    sizes = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per group and range it touches: at most groups + ranges rows, as the ranges follow the group order.
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_range", group).orderBy(*order)
    return (
        ranged.withColumn("_n", F.row_number().over(local))
        .join(F.broadcast(offsets), [group, "_range"])
        .withColumn(name, (F.col("_n") - 1 + F.col("_offset")).cast("long"))
        .drop("_n", "_offset", "_range")
    )


def texts(array: pa.Array) -> pa.Array:
    """A string array without nulls (null counts as empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.fill_null("") if array.null_count else array


def pieces(batches: Iterator[pa.Array], most_bytes: int = 2 << 20) -> Iterator[tuple[pa.Array, bool]]:
    """Cut string arrays into slices of about ``most_bytes`` of text (at least one row each), so memory stays bounded.

    The flag tells whether the slice ends its array.
    """
    for array in batches:
        array = texts(array)
        n, start = len(array), 0
        if not n:
            yield array, True
            continue
        ends = offsets_of(array)
        while start < n:
            stop = start + 1
            while stop < n and ends[stop + 1] - ends[start] <= most_bytes:
                stop += 1
            yield array.slice(start, stop - start), stop == n
            start = stop


def offsets_of(array: pa.Array):
    """Byte offsets of the rows of a string array, as numpy integers."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
