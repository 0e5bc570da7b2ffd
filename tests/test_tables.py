"""Tables in buckets: what a batch rewrites, what readers see after a crash at any step, what is kept."""

import random

import pytest
from pyspark.sql import functions as F

from geoevents.operators import merge, tables
from geoevents.streaming import jobs

SCHEMA = "day string, key long, value long"


def rows(spark, part):
    return spark.createDataFrame(part, SCHEMA)


def upsert(spark, root, part, keep_seconds=0):
    batch = rows(spark, part)
    change = lambda stored: merge.upsert_full(batch.limit(0) if stored is None else stored, batch, ["day", "key"], F.col("value"))
    return tables.change(spark, root, change, F.col("day"), batch, keep_seconds=keep_seconds)


def content(spark, root):
    found = tables.read_version(spark, root)
    return None if found is None else sorted(map(tuple, found.select("day", "key", "value").collect()))


def data_files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


DAYS = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]


def test_a_batch_of_one_day_rewrites_that_day_only(spark, tmp_path):
    root = tmp_path / "t"
    upsert(spark, str(root), [(d, k, 1) for d in DAYS for k in range(20)])
    before = data_files(root)
    upsert(spark, str(root), [(DAYS[1], 3, 9), (DAYS[1], 30, 9)])
    new = {p for p in data_files(root) if p not in before}
    assert new and all(f"_bucket={DAYS[1]}" in str(p) for p in new)
    assert all(data_files(root)[p] == t for p, t in before.items())
    assert content(spark, str(root)) == sorted([(d, k, 9 if (d, k) == (DAYS[1], 3) else 1) for d in DAYS for k in range(20)] + [(DAYS[1], 30, 9)])
    # Readers of one day read that day's files.
    assert all(f"_bucket={DAYS[2]}" in f for f in tables.read_version(spark, str(root), [DAYS[2]]).inputFiles())
    assert tables.current_version(spark, str(root)) == {"version": 2, "eventCount": 81}


@pytest.mark.parametrize("step", ["write", "publish", "clean"])
def test_a_crash_leaves_the_old_version_or_the_new_one(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "t")
    upsert(spark, root, [(d, 1, 1) for d in DAYS])
    old, new = content(spark, root), sorted([(d, 1, 5 if d == DAYS[0] else 1) for d in DAYS])

    def crash(*args, **kwargs):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        if step == "write":
            # Files lie half written in the new folder.
            def stop(stored):
                rows(spark, [(DAYS[0], 1, 5)]).withColumn("_bucket", F.col("day")).write.partitionBy("_bucket").parquet(f"{root}/v00000002-half")
                raise RuntimeError("crash")

            with pytest.raises(RuntimeError):
                tables.change(spark, root, stop, F.col("day"), rows(spark, [(DAYS[0], 1, 5)]))
        else:
            m.setattr(tables, f"_{step}", crash)
            with pytest.raises(RuntimeError):
                upsert(spark, root, [(DAYS[0], 1, 5)])
    assert content(spark, root) == (new if step == "clean" else old)
    upsert(spark, root, [(DAYS[0], 1, 5)])
    assert content(spark, root) == new
    for k in range(5):
        upsert(spark, root, [(DAYS[1], 1, 1)])
    assert content(spark, root) == new
    assert not (tmp_path / "t" / "v00000002-half").exists()


def test_a_repeated_batch_of_a_stream_after_a_crash(spark, tmp_path, monkeypatch):
    source, root, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    kind = "id string, value double, seq bigint"
    land = lambda part: spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.upsert_stream(jobs.read_files(spark, str(source), kind, files_per_batch=1), root, check, ["id"], "seq")
    land([("a", 1.0, 1), ("b", 1.0, 2)])
    run()
    land([("a", 2.0, 3), ("c", 2.0, 4)])
    # The version is out, but the batch is not marked as done: the stream takes it again.
    with monkeypatch.context() as m:
        m.setattr(tables, "_clean", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(Exception, match="crash"):
            run()
    run()
    assert {r["id"]: r["value"] for r in tables.read_version(spark, root).collect()} == {"a": 2.0, "b": 1.0, "c": 2.0}
    assert tables.current_version(spark, root)["version"] == 2


def test_random_batches_equal_a_dict(spark, tmp_path):
    rng, root, want = random.Random(2), str(tmp_path / "t"), {}
    for n in range(6):
        part = {(rng.choice(DAYS), rng.randrange(8)): rng.randrange(1000) for _ in range(rng.randrange(1, 6))}
        upsert(spark, root, [(d, k, v) for (d, k), v in part.items()])
        want |= part
        assert content(spark, root) == sorted((d, k, v) for (d, k), v in want.items())
    # Three versions stay, each pointer names files that are there.
    found = tables._pointers(spark, root)
    assert [p["version"] for p, _ in found] == [4, 5, 6]
    for p, _ in found:
        assert tables._rows(spark, root, p, sorted(p["buckets"])).count() == p["meta"]["eventCount"]
    # Nothing else is left.
    named = {f"{folder}/_bucket={b}" for p, _ in found for b, (folder, _) in p["buckets"].items()}
    there = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t").glob("v*/_bucket=*")}
    assert {t for t in there if int(t[1:9]) < 4} <= named


def test_recent_versions_stay_beyond_the_count(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(6):
        upsert(spark, root, [(DAYS[0], n, n)], keep_seconds=3600)
    assert [p["version"] for p, _ in tables._pointers(spark, root)] == [1, 2, 3, 4, 5, 6]


def test_emptied_buckets_and_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "t")
    batch = rows(spark, [(DAYS[0], 1, 1)])
    tables.change(spark, root, lambda _: batch, F.col("day"), batch)
    tables.change(spark, root, lambda stored: stored.limit(0), F.col("day"), batch)
    found = tables.read_version(spark, root)
    assert found.count() == 0 and found.schema == batch.schema
    tables.change(spark, root, lambda stored: stored.unionByName(batch), F.col("day"), batch)
    assert content(spark, root) == [(DAYS[0], 1, 1)]


def test_rows_of_untouched_buckets_are_refused(spark, tmp_path):
    batch = rows(spark, [(DAYS[0], 1, 1)])
    with pytest.raises(ValueError, match="does not touch"):
        tables.change(spark, str(tmp_path / "t"), lambda _: rows(spark, [(DAYS[1], 1, 1)]), F.col("day"), batch)


def test_retention_rewrites_old_days_and_those_of_the_batch(spark, tmp_path):
    source, root, check = tmp_path / "in", tmp_path / "t", str(tmp_path / "c")
    kind = "id string, occurred_at timestamp, archived_at timestamp"
    land = lambda part: spark.createDataFrame(part, "id string, o string").select("id", F.col("o").cast("timestamp").alias("occurred_at"), F.lit(None).cast("timestamp").alias("archived_at")).coalesce(1).write.mode("append").parquet(str(source))
    as_of, cutoff = F.lit("2024-02-01").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")
    run = lambda: jobs.retention_stream(jobs.read_files(spark, str(source), kind), str(root), check, as_of, cutoff, "7 DAYS")
    land([("old", "2024-01-02"), ("new", "2024-01-20"), ("newer", "2024-01-21")])
    run()
    before = data_files(root)
    land([("late", "2024-01-20")])
    run()
    assert {p.parent.name for p in data_files(root) if p not in before} == {"_bucket=2024-01-02", "_bucket=2024-01-20"}
    assert {r["id"]: r["archived_at"] is not None for r in tables.read_version(spark, str(root)).collect()} == {"old": True, "new": False, "newer": False, "late": False}
