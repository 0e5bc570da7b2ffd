"""Pages from a directory of ranges against slices of the sorted list."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geoevents.operators import paging as P


def rows(n, seed=1):
    r = random.Random(seed)
    return [(f"e{i:05d}", datetime(2024, 1, 1) + timedelta(hours=r.randrange(n // 3)) if i % 50 else None, r.random()) for i in range(n)]


SCHEMA = "id string, occurred_at timestamp_ntz, value double"


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    given = rows(3000)
    root = str(tmp_path_factory.mktemp("pages") / "s")
    P.write_snapshot(spark.createDataFrame(given, SCHEMA), root, range_rows=200)
    order = sorted(given, key=lambda x: (x[1] is None, -(x[1] or datetime(2024, 1, 1)).timestamp(), x[0]))
    return root, order


@pytest.mark.parametrize(("offset", "limit"), [(0, 10), (190, 30), (1500, 700), (2990, 50), (3000, 5)])
def test_pages_by_offset(spark, snapshot, offset, limit):
    root, order = snapshot
    page = P.page_at(spark, root, offset, limit)
    assert [r["id"] for r in page.collect()] == [x[0] for x in order[offset : offset + limit]]


def test_a_deep_page_reads_one_range(spark, snapshot):
    root, order = snapshot
    sizes = [r["n"] for r in P.directory(spark, root)]
    assert sum(sizes) == 3000 and len(sizes) > 10
    first = sum(sizes[:9])
    plan = P.page_at(spark, root, first + 5, 20)
    assert [r["id"] for r in plan.collect()] == [x[0] for x in order[first + 5 : first + 25]]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in text and "= 9" in text


@pytest.mark.parametrize("at", [0, 180, 1234, 2900])
def test_pages_after_a_key(spark, snapshot, at):
    root, order = snapshot
    _, key_at, _ = order[at]
    page = P.page_after(spark, root, key_at, order[at][0], 60)
    assert [r["id"] for r in page.collect()] == [x[0] for x in order[at + 1 : at + 61]]


def test_the_fingerprint_covers_every_column_and_repeated_rows(spark):
    df = spark.createDataFrame(rows(50), SCHEMA)
    of = lambda d: tuple(P.fingerprint(d).first())
    assert of(df) == of(df.orderBy(F.desc("id")).repartition(3))
    assert of(df)[0] != of(df.withColumn("value", F.when(F.col("id") == "e00007", 0.5).otherwise(F.col("value"))))[0]
    assert of(df)[0] != of(df.withColumn("occurred_at", F.when(F.col("id") != "e00000", F.col("occurred_at")).otherwise(F.lit("2024-01-01").cast("timestamp_ntz"))))[0]
    # Two equal rows do not cancel each other.
    twice = df.filter("id = 'e00001'").union(df.filter("id = 'e00001'"))
    assert of(df.union(twice))[0] != of(df)[0]
    assert of(df.limit(0)) == (0, 0)


def test_an_empty_snapshot(spark, tmp_path):
    P.write_snapshot(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert P.directory(spark, str(tmp_path / "e")) == []
