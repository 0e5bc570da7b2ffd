"""Exact dedup as a stream: keyed state on disk, never expired, tells first from later copies; full bytes decide.

Every row gives a fingerprint: the SHA-256 of its normalised text, its ``doc_id`` and its locator (file and row number). A
stateful streaming aggregation keeps per digest the smallest identifier, its locator and the number of rows in RocksDB. The
state is then read back as a table. Rows whose digest was already present are compared byte by byte with the text the locator
names; rows that differ although the digests agree are grouped by their texts instead.

Null texts count as empty. A null ``doc_id`` counts as larger than any other; among equal identifiers the smaller locator stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ROCKSDB_PROVIDER, scratch_path
from .common import partitions, saved

NAME = "op5_exact_dedup"
#: Files of fingerprints that one micro-batch takes.
FILES_PER_BATCH = 200
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State is spread over many small stores, so none reserves disk ahead of use.
RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def normalised(text: Column | str) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return becomes one space."""
    # Single spaces stay as they are, so only the other runs are matched.
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row): rows with the place they can be read from; rows of no file are saved first."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        docs = saved(docs.select("doc_id", "text"), "content")
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def stable_order(id_: str = "doc_id") -> Column:
    return F.struct(F.col(id_).isNull().alias("unknown"), F.col(id_).alias("doc_id"), F.col("file"), F.col("row"))


def run_state(spark: SparkSession, fingerprints: str, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Take all fingerprint files not yet seen under ``checkpoint`` into the state; a restarted run goes on where it stopped."""
    own = spark.newSession()  # the state store's settings concern this stream alone
    own.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    own.conf.set(RESERVE, "false")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions(spark)))
    stream = own.readStream.schema(spark.read.parquet(fingerprints).schema).option("maxFilesPerTrigger", files_per_batch).parquet(fingerprints)
    state = stream.groupBy("digest").agg(F.min(stable_order()).alias("first"), F.count(F.lit(1)).alias("n"))
    # The state itself is the result, so the sink takes nothing.
    job = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, first_id, first_file, first_row, n) of everything seen so far."""
    rows = spark.read.format("statestore").load(checkpoint)
    first = F.col("value.min")
    return rows.select(
        F.col("key.digest").alias("digest"), first["doc_id"].alias("first_id"), first["file"].alias("first_file"), first["row"].alias("first_row"), F.col("value.count").alias("n")
    )


def exact_groups(docs: DataFrame, digest=sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, file, row, digest, keep_id, group_size, kept.

    ``digest`` is a parameter so that tests can force collisions.
    """
    spark = docs.sparkSession
    rows = located(docs)
    prints, checkpoint = scratch_path(spark, "prints"), scratch_path(spark, "dedup-state")
    rows.select("doc_id", "file", "row", digest(normalised("text")).alias("digest")).write.parquet(prints)
    run_state(spark, prints, checkpoint, files_per_batch)
    seen = spark.read.parquet(prints)
    grouped = seen.join(saved(read_state(spark, checkpoint), "state"), "digest")
    is_first = (F.col("file") == F.col("first_file")) & (F.col("row") == F.col("first_row"))
    # Hits: all rows of digests seen more than once, with their texts. Locators are unique, so this join has no hot key.
    repeated = grouped.filter("n > 1").select("file", "row", "digest", "doc_id", is_first.alias("is_first"))
    hits = repeated.join(rows.select("file", "row", normalised("text").alias("body")), ["file", "row"])
    firsts = hits.filter("is_first").select("digest", F.col("body").alias("first_body"))
    strays = saved(hits.filter("not is_first").join(firsts, "digest").filter("body <> first_body").select("file", "row", "digest", "doc_id", "body"), "strays")
    plain = grouped.select("doc_id", "file", "row", "digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"), is_first.alias("kept"))
    if strays.isEmpty():
        return plain
    # Digests agree, bytes do not: the first text's group loses these rows, which form groups by text.
    lost = strays.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    by_text = strays.groupBy("digest", "body").agg(F.min(stable_order()).alias("first"), F.count(F.lit(1)).alias("size"))
    moved = strays.join(by_text, ["digest", "body"]).select("file", "row", "first", "size")
    mended = plain.join(lost, "digest", "left").join(moved, ["file", "row"], "left")
    own = F.col("first").isNotNull()
    return mended.select(
        "doc_id", "file", "row", "digest",
        F.when(own, F.col("first.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(own, F.col("size")).otherwise(F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.when(own, (F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row"))).otherwise(F.col("kept")).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = docs
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        marked = saved(docs, "content")
    dropped = exact_groups(marked).filter("not kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    placed = marked.select("*", F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row"))
    gone = (F.col("_at_file") == F.col("_file")) & (F.col("_at_row") == F.col("_row"))
    return placed.join(dropped, gone, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
