"""Tables kept as versions. A version is a pointer that says, bucket by bucket, in which folder the rows lie.

A batch writes new files for the buckets it touches and then a new pointer, which names the new folder for these buckets and the
old ones for all others. Nothing that a reader can see is ever overwritten: whatever step a crash comes at, readers have the old version or the whole
new one, and a repeated attempt writes to a folder of its own. A table without buckets is one bucket, rewritten as a whole.

The pointer has one entry per bucket, so the number of buckets is a choice of the caller that stays small beside the rows: a fixed number of hashes, or days.
Names of buckets are letters, digits, ``-`` and ``_``. One writer at a time; readers need no lock. Folders are listed and removed through Hadoop's
file system, which Spark reaches in the driver's JVM (a classic session, not Connect).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Versions that stay readable after a new one is written, and how long a version stays in any case after the next one came.
KEPT_VERSIONS, KEPT_SECONDS = 3, 3600
BUCKET = "_bucket"
WHOLE = ""
FOLDER = re.compile(r"v(\d{8})-\w+")


def by_hash(keys: list[str], buckets: int) -> Column:
    """Bucket of a row by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def by_day(time_: Column) -> Column:
    return F.coalesce(F.date_format(time_, "yyyy-MM-dd"), F.lit("none"))


def change(spark: SparkSession, root: str, step: Callable[[DataFrame | None], DataFrame], bucket: Column | None = None,
           batch: DataFrame | None = None, also: Callable[[list[str]], list[str]] | None = None, meta: dict | None = None, keep_seconds: int = KEPT_SECONDS) -> int:
    """The next version: ``step`` turns the stored rows of the touched buckets (None before the first version) into their new rows.

    Touched are the buckets of the rows of ``batch``, and those that ``also`` picks from the stored ones. Without ``bucket`` the table is one bucket.
    """
    newest = _newest(spark, root)
    if bucket is None:
        names = [WHOLE]
    else:
        # At most as many names as there are buckets.
        names = [r[0] for r in batch.select(bucket).distinct().collect()]
        names = sorted({*names, *(also(sorted(newest["buckets"])) if also and newest else [])})
    rows = step(None if newest is None else _rows(spark, root, newest, names))
    version = (newest or {"version": 0})["version"] + 1
    folder = f"v{version:08d}-{uuid.uuid4().hex}"
    if bucket is None:
        rows.write.parquet(f"{root}/{folder}")
        counts = {WHOLE: spark.read.schema(rows.schema).parquet(f"{root}/{folder}").count()}
    else:
        # The hint deals rows out by bucket and splits a large one into several files.
        rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
        placed = spark.read.schema(StructType([*rows.schema.fields, StructField(BUCKET, StringType())])).parquet(f"{root}/{folder}")
        counts = {r[BUCKET]: r["count"] for r in placed.groupBy(BUCKET).count().collect()}
    strange = set(counts) - set(names)
    if strange:
        raise ValueError(f"rows moved to buckets that the batch does not touch: {sorted(strange)[:5]}")
    buckets = {b: e for b, e in (newest or {"buckets": {}})["buckets"].items() if b not in names}
    buckets |= {b: [folder, n] for b, n in counts.items()}
    said = {"version": version, "at": time.time(), "schema": rows.schema.json(), "buckets": buckets, "meta": {**(meta or {}), "eventCount": sum(n for _, n in buckets.values())}}
    _publish(spark, root, said)
    _clean(spark, root, keep_seconds)
    return version


def write_version(rows: DataFrame, root: str, meta: dict | None = None, keep_seconds: int = KEPT_SECONDS) -> int:
    """A new complete version."""
    return change(rows.sparkSession, root, lambda _: rows, meta=meta, keep_seconds=keep_seconds)


def current_version(spark: SparkSession, root: str) -> dict | None:
    """Number and notes of the newest version."""
    newest = _newest(spark, root)
    return None if newest is None else {"version": newest["version"], **newest["meta"]}


def read_version(spark: SparkSession, root: str, buckets: list[str] | None = None) -> DataFrame | None:
    """The rows of the newest version, of all buckets or the given ones."""
    newest = _newest(spark, root)
    return None if newest is None else _rows(spark, root, newest, sorted(newest["buckets"]) if buckets is None else buckets)


def load_first(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, str]:
    """The first readable snapshot in the given order (live copy before fallback, or the other way round)."""
    for root in roots:
        rows = read_version(spark, root)
        if rows is not None:
            return rows, root
    raise FileNotFoundError(f"no readable snapshot in {roots}")


def _place(root: str, bucket: str, folder: str) -> str:
    return f"{root}/{folder}" if bucket == WHOLE else f"{root}/{folder}/{BUCKET}={bucket}"


def _rows(spark: SparkSession, root: str, pointer: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(pointer["schema"]))
    paths = [_place(root, b, pointer["buckets"][b][0]) for b in buckets if b in pointer["buckets"]]
    # The bucket's name is no column: folders are taken as they are.
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, root: str, said: dict) -> None:
    """The pointer is one file, which appears as a whole; from then on readers see the version."""
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("append").text(f"{root}/_pointer")


def _pointers(spark: SparkSession, root: str) -> list[tuple[dict, str]]:
    """(pointer, file), oldest first: the kept ones and what a crash left."""
    files, where = _files(spark, f"{root}/_pointer")
    if not files.exists(where):
        return []
    rows = spark.read.text(f"{root}/_pointer", wholetext=True).select("value", "_metadata.file_path").collect()
    return sorted(((json.loads(r[0]), r[1]) for r in rows), key=lambda p: p[0]["version"])


def _newest(spark: SparkSession, root: str) -> dict | None:
    found = _pointers(spark, root)
    return found[-1][0] if found else None


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as Hadoop's objects."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _clean(spark: SparkSession, root: str, keep_seconds: int) -> None:
    """Remove versions that are neither among the last few nor recent, and what no kept version names."""
    pointers = _pointers(spark, root)
    newest = pointers[-1][0]["version"]
    ended = {p["version"]: after["at"] for (p, _), (after, _) in zip(pointers, pointers[1:])}
    old = {v for v, at in ended.items() if v <= newest - KEPT_VERSIONS and at <= time.time() - keep_seconds}
    kept = [p for p, _ in pointers if p["version"] not in old]
    oldest = kept[0]["version"]
    named: dict[str, set[str]] = {}
    for p in kept:
        for b, (folder, _) in p["buckets"].items():
            named.setdefault(folder, set()).add(b)
    files, base = _files(spark, root)
    for status in files.listStatus(base):
        folder = status.getPath().getName()
        form = FOLDER.fullmatch(folder)
        # What came with the oldest kept version or later may belong to it, or to an attempt under way.
        if not form or int(form[1]) >= oldest:
            continue
        if folder not in named:
            files.delete(status.getPath(), True)
        elif WHOLE not in named[folder]:
            for part in files.listStatus(status.getPath()):
                name = part.getPath().getName()
                if name.startswith(f"{BUCKET}=") and name[len(BUCKET) + 1 :] not in named[folder]:
                    files.delete(part.getPath(), True)
    for p, file in pointers:
        if p["version"] in old:
            files.delete(_files(spark, file)[1], False)
