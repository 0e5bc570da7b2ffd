"""Shards of near-equal bytes by longest processing time first: the largest group goes to the least loaded shard.

Rows of equal text form a group and stay together. Groups are scheduled on the driver with a heap, but never one by one over the
whole corpus: groups are put in order of falling size and gathered into bundles that shrink in proportion to what is left, so
the number of bundles has a fixed bound (``bundle_bound``) at any corpus size. Groups larger than the largest bundle are items of
their own; there are at most ``shards * GRAIN`` of them. The last bundles hold a millionth of all bytes, which evens the loads out.

Null texts have no bytes, so they belong with the empty texts' checksum but form a group of their own. Repeated rows count each.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, running, saved

NAME = "op6_sharding"
SHARDS = 40
#: A first bundle is this fraction (one in GRAIN) of a shard; the last one is LEAST of all bytes.
GRAIN = 100
LEAST = 1e-6
ROW_BYTES = 16
LAW = "bytes"


def bundle_bound(shards: int) -> int:
    """Most items the driver ever schedules."""
    return shards * GRAIN + math.ceil(shards * GRAIN * math.log(1 / LEAST)) + 2


def schedule(items: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(item, shard) by longest processing time: items (id, size) sorted by falling size, each to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append((item, s))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(text), F.md5(text.cast("binary")), F.col("text").isNull()).alias("same"),
    )
    rows = saved(rows.withColumn("same", F.xxhash64("same")), "sized")
    # Groups are keyed by a 64-bit hash of two digests; should two texts share it, they merely stay together as well.
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    ordered = running(groups, [F.col("bytes").desc(), F.col("same")], "groups")
    sums = ordered.groupBy("_range").agg(F.sum("bytes").alias("held"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as there are shuffle partitions.
    offsets = sums.select("_range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy(F.lit(0))).alias("total"))
    local = Window.partitionBy("_range").orderBy(F.col("bytes").desc(), "same").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.withColumn("upto", F.sum("bytes").over(local)).join(F.broadcast(offsets), "_range")
    left = 1 - (F.col("upto") - F.col("bytes") + F.col("offset")) / F.col("total")
    bundle = F.floor(-F.log(F.greatest(left, F.lit(LEAST))) * shards * GRAIN)
    alone = F.col("bytes") * shards * GRAIN > F.col("total")
    # Large groups come first in the order; their numbers are negative and count along it.
    member = placed.select("same", "bytes", F.when(alone, -1 - F.floor((F.col("upto") - F.col("bytes") + F.col("offset")) * shards * GRAIN / F.col("total"))).otherwise(bundle).alias("item"))
    member = saved(member, "members")
    # At most bundle_bound(shards) rows, whatever the corpus.
    items = [(r["item"], r["bytes"]) for r in member.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()]
    plan = spark.createDataFrame(schedule(items, shards), "item long, shard int")
    where = member.join(F.broadcast(plan), "item").select("same", "shard")
    return numbered(rows.join(where, "same"), "shard", [F.col("same"), F.col("doc_id"), F.col("size")], "slot", "shards").select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
