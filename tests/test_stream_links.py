"""A stream of news and disasters that writes its rows instead of their pairs."""

from pyspark.sql import functions as F

from geoevents.streaming import jobs


def test_links_are_read_from_rows(spark, tmp_path):
    source = tmp_path / "in"
    kind = "id string, news boolean, lat double, lng double, ts timestamp"
    batches = [
        [("d1", 10.0, 179.9, "01 00:00:00"), ("d2", 50.0, 8.0, "05 00:00:00"), ("d3", None, 8.0, "05 00:00:00")],
        [("n1", 10.0, -179.9, "08 00:00:00"), ("n2", 10.0, -179.9, "08 00:00:00.000001"), ("n3", 50.5, 8.0, "04 23:59:59"), ("d4", 10.0, 179.0, "08 00:00:00")],
        [("d5", 50.0, 8.5, "07 00:00:00"), ("n4", 50.0, 8.0, "11 00:00:00"), ("d6", -80.0, 0.0, "20 00:00:00"), ("d7", 10.0, 179.8, "06 12:00:00")],
        [("n5", 50.0, 8.0, "09 00:00:00"), ("d8", 50.0, 8.0, "02 00:00:00"), ("n6", 50.0, 8.0, "09 00:00:01")]]
    late, rows = {True: 0, False: 0}, 0
    place = lambda listed: (str(tmp_path / f"o{listed}"), str(tmp_path / f"c{listed}"))
    for batch in batches:
        rows += len(batch)
        df = spark.createDataFrame([(i, i.startswith("n"), lat, lng, f"2024-01-{at}") for i, lat, lng, at in batch], "id string, news boolean, lat double, lng double, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        for listed in (True, False):
            read = lambda: jobs.read_files(spark, str(source), kind)
            late[listed] += jobs.news_disaster_stream(read().filter("news"), read().filter("NOT news"), *place(listed), 200.0, 7, listed=listed)
    pairs = lambda df: sorted((r.news_id, r.disaster_id, round(r.km, 6)) for r in df.collect())
    kept = spark.read.parquet(place(False)[0])
    assert late == {True: 2, False: 2} and kept.count() == rows - 2 and "news_id" not in kept.columns
    want = pairs(spark.read.parquet(place(True)[0]))
    assert len(want) == 9 and pairs(jobs.news_disaster_links(spark, place(False)[0], 200.0, 7)) == want
