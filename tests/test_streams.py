"""Streaming jobs over several files, stopped and continued from their checkpoints."""

from pyspark.sql import functions as F

from geoevents.operators import merge
from geoevents.streaming import jobs

KIND = "id string, user_id int, value double, ts timestamp, seq bigint"


def land(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "id string, user_id int, value double, ts string, seq bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return name


def test_upsert_continues_and_is_applied_once(spark, tmp_path):
    source, root, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    land(spark, source, [("a", 1, 1.0, "2024-01-01 00:00:00", 1), ("b", 1, 2.0, "2024-01-01 00:00:00", 2)], "1")
    run = lambda: jobs.upsert_stream(jobs.read_files(spark, str(source), KIND), root, check, ["id"], "seq")
    run()
    land(spark, source, [("a", 1, 9.0, "2024-01-02 00:00:00", 3), ("a", 1, 8.0, "2024-01-02 00:00:00", 2)], "2")
    run()
    run()  # nothing new
    assert {r["id"]: r["value"] for r in merge.read_version(spark, root).collect()} == {"a": 9.0, "b": 2.0}
    assert merge.current_version(spark, root)["version"] == 2
    # A repeated batch of the same checkpoint leaves the table alone.
    jobs.apply_once(root, 1, spark, lambda stored: stored.limit(0), check)
    assert merge.read_version(spark, root).count() == 2


def test_new_checkpoint_and_second_stream_are_not_taken_for_repeats(spark, tmp_path):
    root = str(tmp_path / "t")
    for k, value in enumerate([1.0, 2.0, 3.0]):
        source = tmp_path / f"in{k}"
        land(spark, source, [(f"x{k}", 1, value, "2024-01-01 00:00:00", k)], "1")
        jobs.upsert_stream(jobs.read_files(spark, str(source), KIND), root, str(tmp_path / f"c{k}"), ["id"], "seq")
    assert {r["id"]: r["value"] for r in merge.read_version(spark, root).collect()} == {"x0": 1.0, "x1": 2.0, "x2": 3.0}


def test_upsert_goes_on_after_a_crash_before_the_pointer(spark, tmp_path):
    root = str(tmp_path / "t")
    merge.write_version(spark.range(2), root, keep_seconds=0)
    # What a crashed attempt at version 2 leaves behind.
    spark.range(9).write.parquet(f"{root}/v00000002-crashed")
    assert merge.read_version(spark, root).count() == 2
    for n in (3, 4, 5, 6):
        merge.write_version(spark.range(n), root, keep_seconds=0)
    assert merge.read_version(spark, root).count() == 6
    left = sorted(p.name[:9] for p in (tmp_path / "t").iterdir() if p.name.startswith("v"))
    assert left == ["v00000003", "v00000004", "v00000005"]


def test_density_emits_closed_days_only(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    kind = "lat double, lng double, weight double, ts timestamp"
    add = lambda days: spark.createDataFrame([(1.0, 2.0, 1.0, f"2024-01-{d:02d} 10:00:00") for d in days], "lat double, lng double, weight double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.cell_density_stream(jobs.read_files(spark, str(source), kind), out, check)
    add([1, 1, 2, 6])
    run()
    add([1, 7, 20])  # the first is too late: its day is closed
    assert run() == 1, "and is counted"
    got = {r["start"].day: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 2, 2: 1, 6: 1, 7: 1}


def test_items_are_unique_across_polls(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    run = lambda: jobs.unique_items(jobs.read_files(spark, str(source), KIND), ["id"], out, check)
    land(spark, source, [("a", 1, 1.0, "2024-01-01 00:00:00", 1), ("a", 1, 1.0, "2024-01-01 01:00:00", 2)], "1")
    run()
    land(spark, source, [("a", 1, 1.0, "2024-01-01 02:00:00", 3), ("b", 1, 1.0, "2024-01-01 02:00:00", 4)], "2")
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_feed_health_counts_consecutive_failures(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    land_polls = lambda rows: spark.createDataFrame(rows, "feed_url string, seq bigint, ok boolean").coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.feed_health_stream(jobs.read_files(spark, str(source), "feed_url string, seq bigint, ok boolean"), out, check)
    land_polls([("x", i, False) for i in range(3)] + [("y", 0, True), ("y", 2, False), ("y", 1, False)])
    run()
    land_polls([("x", i, False) for i in range(3, 6)] + [("y", 3, True), ("y", 4, False)])
    run()
    got = {r["feed_url"]: (r["error_count"], r["paused"]) for r in jobs.latest_health(spark, out).collect()}
    assert got == {"x": (6, True), "y": (1, False)}


def test_profile_over_batches_equals_one_batch(spark, tmp_path):
    kind = "user_id int, event_id string, kind string, view string, acted_at timestamp, seq bigint"
    kinds = ["save", "unsave", "more", "less", "clear", "open", "source"]
    rows = [(i % 3, f"e{(i * 7) % 5}", kinds[(i * 11) % 7], "feed", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i) for i in range(240)]
    frame = lambda part: spark.createDataFrame(part, kind.replace("timestamp", "string")).withColumn("acted_at", F.col("acted_at").cast("timestamp")).coalesce(1)
    results = []
    for name, parts in (("one", [rows]), ("many", [rows[:50], rows[50:51], rows[51:180], rows[180:]])):
        source, root, check = tmp_path / name / "in", str(tmp_path / name / "t"), str(tmp_path / name / "c")
        for part in parts:
            frame(part).write.mode("append").parquet(str(source))
            jobs.profile_stream(jobs.read_files(spark, str(source), kind), root, check)
        results.append(sorted(map(str, merge.read_version(spark, root).select("user_id", "event_id", "kind", "view", "acted_at", "seq").collect())))
    assert results[0] == results[1]


def test_hotspots_over_batches(spark, tmp_path):
    source, root, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    kind = "lat double, lng double, acq_at timestamp, frp double"
    add = lambda frps: spark.createDataFrame([(1.1, 2.1, "2024-01-01 05:00:00", f) for f in frps], kind.replace("timestamp", "string")).withColumn("acq_at", F.col("acq_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.hotspot_stream(jobs.read_files(spark, str(source), kind), root, check)
    add([1.0, 2.0, 3.0])
    run()
    assert jobs.clusters_of(merge.read_version(spark, root)).count() == 0
    add([1.0] * 4 + [13.0])
    run()
    row = jobs.clusters_of(merge.read_version(spark, root)).first()
    assert (row["hotspot_count"], row["max_frp"], row["mean_frp"], row["cell_lat"]) == (8, 13.0, 23 / 8, 1.0)


def test_late_polls_of_a_feed(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    polls = lambda rows: spark.createDataFrame(rows, "feed_url string, seq bigint, ok boolean").coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.feed_health_stream(jobs.read_files(spark, str(source), "feed_url string, seq bigint, ok boolean"), out, check)
    errors = lambda: {r["feed_url"]: r["error_count"] for r in jobs.latest_health(spark, out).collect()}
    polls([("a", 10, True), ("b", 5, False), ("b", 7, False)])
    run()
    assert errors() == {"a": 0, "b": 2}
    # Failures before the last success don't count; a late success takes back the failures before it.
    polls([("a", 8, False), ("a", 9, False), ("b", 6, True)])
    run()
    assert errors() == {"a": 0, "b": 1}


def test_ids_are_never_forgotten_unless_asked(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    for k, day in enumerate(["2024-01-01", "2024-03-01", "2024-06-01"]):
        land(spark, source, [("same", 1, 1.0, f"{day} 00:00:00", k), (f"only{k}", 1, 1.0, f"{day} 00:00:00", k)], "1")
        jobs.unique_items(jobs.read_files(spark, str(source), KIND), ["id"], out, check)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["only0", "only1", "only2", "same"]


def test_state_of_a_feed_that_never_succeeds_stays_small(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    polls = lambda rows: spark.createDataFrame(rows, "feed_url string, seq bigint, ok boolean").coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: jobs.feed_health_stream(jobs.read_files(spark, str(source), "feed_url string, seq bigint, ok boolean"), out, check, listed=20)
    latest = lambda: {r["feed_url"]: (r["error_count"], r["late"]) for r in spark.read.parquet(out).groupBy("feed_url").agg(F.max_by(F.struct("error_count", "late"), "batch").alias("s")).select("feed_url", "s.*").collect()}
    for k in range(3):
        polls([("never", k * 100 + i, False) for i in range(100)] + [("once", k * 100 + i, False) for i in range(100)])
        run()
    assert latest() == {"never": (300, 0), "once": (300, 0)}
    state = spark.read.format("statestore").load(check)
    assert state.select(F.max(F.size("value.groupState.failed"))).first()[0] == 20
    # A late failure counts; a success among the listed ones takes back what is before it; one among the others is too late.
    polls([("never", 50, True), ("never", 51, False), ("once", 289, True), ("once", 5, False)])
    run()
    assert latest() == {"never": (301, 1), "once": (10, 0)}


def test_news_and_disasters_meet_over_batches(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "c")
    kind = "id string, news boolean, lat double, lng double, ts timestamp"

    def add(*rows):
        df = spark.createDataFrame([(i, i.startswith("n"), lat, lng, f"2024-01-{at}") for i, lat, lng, at in rows], "id string, news boolean, lat double, lng double, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        rows = jobs.read_files(spark, str(source), kind)
        return jobs.news_disaster_stream(rows.filter("news"), jobs.read_files(spark, str(source), kind).filter("NOT news"), out, check, 200.0, 7)

    pairs = lambda: sorted((r["news_id"], r["disaster_id"]) for r in spark.read.parquet(out).collect())
    opened = lambda k: {r["id"] for r in spark.read.parquet(f"{out}-open/{k % 2}").collect()}
    # A side is empty: nothing is late. News exactly 7 days after a disaster counts, a microsecond more doesn't; the date line is crossed.
    add(("d1", 10.0, 179.9, "01 00:00:00"), ("d2", 50.0, 8.0, "05 00:00:00"), ("d3", None, 8.0, "05 00:00:00"))
    assert run() == 0 and pairs() == [] and opened(0) == {"d1", "d2", "d3"}
    add(("n1", 10.0, -179.9, "08 00:00:00"), ("n2", 10.0, -179.9, "08 00:00:00.000001"), ("n3", 50.5, 8.0, "04 23:59:59"), ("d4", 10.0, 179.0, "08 00:00:00"))
    assert run() == 0 and pairs() == [("n1", "d1"), ("n1", "d4"), ("n2", "d4")]
    # An older disaster that is still in time meets the news of an earlier batch.
    add(("d5", 50.0, 8.5, "07 00:00:00"), ("n4", 50.0, 8.0, "11 00:00:00"), ("d6", -80.0, 0.0, "20 00:00:00"), ("d7", 10.0, 179.8, "06 12:00:00"))
    assert run() == 0 and pairs() == [("n1", "d1"), ("n1", "d4"), ("n1", "d7"), ("n2", "d4"), ("n2", "d7"), ("n4", "d2"), ("n4", "d5")]
    # The side that is behind stood at the 11th: until the 9th is too late. Rows that nothing in time can meet are gone.
    assert opened(2) == {"n4", "d2", "d3", "d4", "d5", "d6", "d7"}
    before = pairs()
    add(("n5", 50.0, 8.0, "09 00:00:00"), ("d8", 50.0, 8.0, "02 00:00:00"), ("n6", 50.0, 8.0, "09 00:00:01"))
    assert run() == 2
    assert pairs() == sorted([*before, ("n6", "d2"), ("n6", "d5")])
    assert run() == 0 and len(pairs()) == len(before) + 2
