"""Pages of an ordered result from a directory of its ranges, bound to a fingerprint of the whole result.

A snapshot is written once in ranges of the order, with a directory of one small row per range: its number of rows, its newest and oldest time, and a hash of its rows. A page by
offset, or after a key, then reads the ranges it lies in and no others, however deep it is. The fingerprint adds up a hash of every whole row, so it
changes with any column of any row, and equal rows count as often as they are there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RANGE_ROWS = 100_000
#: Hashes have 60 bits, and so have their sums.
BITS = 60


def row_hash(columns: list[Column | str]) -> Column:
    """60-bit hash of a row by the text of its columns, null apart from empty."""
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def _sum(hashes: Column) -> Column:
    return (F.sum(hashes.cast("decimal(20,0)")) % F.lit(1 << BITS).cast("decimal(20,0)")).cast("bigint")


def fingerprint(rows: DataFrame, columns: list[Column | str] | None = None) -> DataFrame:
    """(fingerprint, total) of a set of rows in which rows may repeat; combines map-side and needs no order."""
    return rows.agg(F.coalesce(_sum(row_hash(columns or rows.columns)), F.lit(0)).alias("fingerprint"), F.count(F.lit(1)).alias("total"))


def write_snapshot(events: DataFrame, root: str, columns: list[Column | str] | None = None, range_rows: int = RANGE_ROWS) -> None:
    """Events (id, occurred_at, …) in the canonical order, newest first, then by id. ``columns`` is what the fingerprint covers, by default every column."""
    n = max(1, -(-events.count() // range_rows))
    hashed = events.withColumn("_hash", row_hash(columns or events.columns))
    hashed.repartitionByRange(n, F.desc("occurred_at"), F.asc("id")).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{root}/rows")
    schema = StructType([*hashed.schema.fields, StructField("_range", IntegerType())]).json()
    events.sparkSession.createDataFrame([(schema,)], "schema string").coalesce(1).write.parquet(f"{root}/schema")
    rows = _rows(events.sparkSession, root)
    rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), _sum(F.col("_hash")).alias("hash"), F.max("occurred_at").alias("newest"), F.min("occurred_at").alias("oldest")).write.parquet(f"{root}/directory")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{root}/schema").first()["schema"]))
    return spark.read.schema(schema).parquet(f"{root}/rows")


def directory(spark: SparkSession, root: str) -> list:
    """The ranges in order; one row per range."""
    return sorted(spark.read.parquet(f"{root}/directory").collect(), key=lambda r: r["_range"])


def _page(spark: SparkSession, root: str, found: list, ranges: list[int]) -> DataFrame:
    whole = (sum(r["hash"] for r in found) % (1 << BITS), sum(r["n"] for r in found))
    rows = _rows(spark, root).filter(F.col("_range").isin(ranges)).drop("_hash")
    return rows.withColumns({"fingerprint": F.lit(whole[0]).cast("bigint"), "total": F.lit(whole[1]).cast("bigint")}).orderBy(F.desc("occurred_at"), F.asc("id")).drop("_range")


def page_at(spark: SparkSession, root: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` … ``offset + limit`` of the order, with the fingerprint and size of the whole."""
    found, first, ranges, skip = directory(spark, root), 0, [], 0
    for r in found:
        if first < offset + limit and first + r["n"] > offset:
            skip = offset - first if not ranges else skip
            ranges.append(r["_range"])
        first += r["n"]
    return _page(spark, root, found, ranges).offset(skip).limit(limit)


def page_after(spark: SparkSession, root: str, occurred_at, id_: str, limit: int) -> DataFrame:
    """The ``limit`` rows behind a row given by its (dated) key. Reads as many ranges as it takes to fill the page."""
    found = directory(spark, root)
    start = next((k for k, r in enumerate(found) if r["oldest"] is None or r["oldest"] <= occurred_at), len(found))
    # The first range may end with the key itself; so may the next ones of the same moment, by at most their rows.
    ranges, rows = [], 0
    for r in found[start:]:
        ranges.append(r["_range"])
        behind = r["newest"] is None or r["newest"] < occurred_at
        rows += r["n"] if behind else 0
        if rows >= limit:
            break
    behind = F.col("occurred_at").isNull() | (F.col("occurred_at") < F.lit(occurred_at)) | ((F.col("occurred_at") == F.lit(occurred_at)) & (F.col("id") > id_))
    return _page(spark, root, found, ranges).filter(behind).limit(limit)
