"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding.

Each stage takes what the one before kept, as Parquet in the shared folder. The first four drop rows and return the columns of
``documents``; the last returns the ids and digests of what is left. A stage keeps rows with null ids or texts unless its
operator rejects them, and passes extra columns on; see the operators' docstrings for each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoevents.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from geoevents.llm.common import saved

#: Words in a shingle of the near-copy stage.
NEAR_SHINGLE = 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies."""
    return near_dedup.deduplicated(docs, NEAR_SHINGLE)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_benchmark_leak")
    return found.filter(F.col("_benchmark_leak.n_hit") == 0).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the text decoded from them."""
    tokens = bpe.tokenised(docs.select("doc_id", "text", "lang", "source"))
    return tokens.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("byte-level BPE", token_ids),
]

#: A trained classifier has no SQL twin; tests/llm/test_pipeline.py compares each stage with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
