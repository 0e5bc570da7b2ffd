"""Readers on landed files: one row of each kind, and rows that must be dropped."""

import json

from pyspark.sql import functions as F

from geoevents.operators import exposure as E
from geoevents.operators import filters as FI
from geoevents.operators import merge as M
from geoevents.sources import feeds as S
from geoevents.sources import kinds as K

AS_OF = "2026-10-04 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_quakes(spark, tmp_path):
    good = {"id": "us7", "properties": {"mag": 6.2, "place": "15 km SW of Napa", "time": 1791028800000, "updated": 1791028900000, "sig": 800, "tsunami": 1, "felt": 12, "magType": "mww"}, "geometry": {"coordinates": [-122.4, 37.8, 10.0]}}
    bare = {"id": None, "properties": {"code": "c1", "mag": 2.0, "time": 1791028800000}, "geometry": {"coordinates": [1.0, 2.0]}}
    nowhere = {"id": "x", "properties": {"time": 1}, "geometry": {"coordinates": []}}
    path = write(tmp_path / "q", "a.json", json.dumps({"type": "FeatureCollection", "features": [good, bare, nowhere]}, indent=1))
    rows = {r["event_id"]: r for r in S.quake_events(S.read_features(spark, path, S.QUAKE_SCHEMA)).collect()}
    assert set(rows) == {"usgs:us7", "usgs:c1"}
    assert rows["usgs:us7"]["alt_m"] == -10000 and rows["usgs:us7"]["significance"] == 800 and rows["usgs:us7"]["detail"]["tsunami"]
    assert rows["usgs:us7"]["entities"][0]["text"] == "15 km SW of Napa"
    assert rows["usgs:c1"]["significance"] == 20 and rows["usgs:c1"]["title"] == "M 2.0" and rows["usgs:c1"]["alt_m"] is None


def test_alerts(spark, tmp_path):
    flood = {"properties": {"eventtype": "FL", "eventid": 9, "episodeid": 2, "name": "Flood", "alertlevel": "Orange", "alertscore": 1.5, "fromdate": "2026-10-01T00:00:00", "iso3": ["bgd"],
                            "url": {"report": "https://r"}, "severitydata": {"severity": 3, "severityunit": "", "severitytext": "deep"}}, "geometry": {"type": "Point", "coordinates": [90.0, 24.0]}}
    storm = {"properties": {"eventtype": "tc", "eventid": 1, "alertscore": "0.5", "iso3": {"iso3": "phl"}, "url": "https://u", "longitude": "120", "latitude": 15, "severitydata": '{"severity": "185", "severityunit": "km/h"}'}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2]]]}}
    lost = {"properties": {"eventtype": "XX", "eventid": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    path = write(tmp_path / "g", "a.json", json.dumps({"features": [flood, storm, lost]}))
    rows = {r["category"]: r for r in S.alert_events(S.read_features(spark, path, S.ALERT_SCHEMA), as_of()).collect()}
    assert set(rows) == {"flood", "cyclone"}
    assert rows["flood"]["event_id"] == "gdacs:FL:9:2" and rows["flood"]["significance"] == 70 and rows["flood"]["country_iso3"] == "BGD"
    assert rows["flood"]["detail"]["flood_severity_score"] == 3 and rows["flood"]["info_url"] == "https://r" and rows["flood"]["summary"] == "deep"
    assert rows["cyclone"]["event_id"] == "gdacs:TC:1:0" and rows["cyclone"]["significance"] == 15 and rows["cyclone"]["detail"]["max_wind_kmh"] == 185
    assert (rows["cyclone"]["lng"], rows["cyclone"]["lat"], rows["cyclone"]["country_iso3"], rows["cyclone"]["weight"]) == (120.0, 15.0, "PHL", 185.0)


def test_hotspots(spark, tmp_path):
    path = write(tmp_path / "h", "a.csv", "latitude,longitude,bright_ti4,acq_date,acq_time,satellite,confidence,frp,daynight\n1.23456,2.5,300,2026-10-03,45,N,n,12.5,D\n,2.5,300,2026-10-03,45,N,n,1,D\n1,2,300,soon,45,N,n,1,D\n")
    rows = S.hotspots(S.read_rows(spark, path, S.HOTSPOT_SCHEMA)).collect()
    assert [r["hotspot_id"] for r in rows] == ["firms:N:2026-10-03:0045:1.2346:2.5000"] and rows[0]["frp"] == 12.5 and rows[0]["acq_at"].minute == 45


def test_hotspots_with_more_columns_than_are_used(spark, tmp_path):
    names = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight"
    path = write(tmp_path / "wide", "a.csv", names + "\n10.5,20.5,330.1,0.4,0.4,2026-10-04,0130,N,VIIRS,n,2.0NRT,290.0,12.5,D\n")
    row = S.read_rows(spark, path, S.HOTSPOT_SCHEMA).first()
    assert (row["latitude"], row["acq_time"], row["frp"], row["daynight"]) == ("10.5", "0130", "12.5", "D")
    assert S.hotspots(S.read_rows(spark, path, S.HOTSPOT_SCHEMA)).count() == 1


def test_files_with_different_headers_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "mixed files"
    write(folder, "a.csv", "latitude,longitude,frp\n1,2,3\n4,5,6\n")
    write(folder, "b.csv", "frp,latitude,longitude\n30,10,20\n")
    write(folder, "c.csv", "\ufeff\"latitude\",longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\r\n7,8,330.1,0.4,0.4,2026-10-04,0130,N,VIIRS,n,2.0NRT,290.0,9,D\r\n")
    write(folder, "d.csv", "latitude,longitude,brightness,acq_date,acq_time,satellite,confidence,frp,daynight\n1.5,2.5,301.5,2026-10-03,45,N,n,12.5,D\n")
    write(folder, "only header.csv", "latitude,longitude,frp\n")
    write(folder, "empty.csv", "")
    found = S.read_rows(spark, str(folder), S.HOTSPOT_SCHEMA)
    got = sorted((r["latitude"], r["longitude"], r["frp"], r["acq_time"]) for r in found.collect())
    assert got == [("1", "2", "3", None), ("1.5", "2.5", "12.5", "45"), ("10", "20", "30", None), ("4", "5", "6", None), ("7", "8", "9", "0130")]
    assert sorted((r["lat"], r["brightness"]) for r in S.hotspots(found).collect()) == [(1.5, 301.5), (7.0, 330.1)]


def test_no_files_with_text(spark, tmp_path):
    assert S.read_rows(spark, write(tmp_path / "none", "a.csv", "\n"), S.HOTSPOT_SCHEMA).collect() == []


def test_conflict_answers_and_coded_files(spark, tmp_path):
    row = {"event_id_cnty": "KLO7", "event_date": "2025-02-11", "event_type": "Battles", "sub_event_type": "Armed clash", "actor1": "Harbour Guard", "latitude": "-7.5", "longitude": 31.25, "fatalities": 3, "geo_precision": 1, "country": "Kalonia", "location": "Port Mira", "timestamp": 1739318400, "unknown": [1]}
    path = write(tmp_path / "acled", "page1.json", json.dumps({"status": 200, "data": [row, {**row, "event_id_cnty": "KLO8", "latitude": None}]}, indent=1))
    write(tmp_path / "acled", "page2.json", json.dumps({"data": []}))
    (event,) = S.conflict_events(S.read_conflicts(spark, path)).collect()
    assert (event["source_event_id"], event["lng"], event["weight"], event["detail"]["fatalities"], event["title"]) == ("KLO7", 31.25, 3.0, 3, "Armed clash in Port Mira, Kalonia")
    assert str(event["updated_at"]) == "2025-02-12 00:00:00" and event["geo_precision"] == "point"
    path = write(tmp_path / "coded", "a.csv", 'SQLDATE,Actor1Name,ActionGeo_FullName,ActionGeo_Lat,ActionGeo_Long,GoldsteinScale,NumArticles,SOURCEURL,title,description,category,EventCode\n20250211,GUARD,"Port Mira, Kalonia",-7.5,31.0,-10.0,12,https://p.test/a,"A ""big"" title","two\nlines",conflict,190\n')
    write(tmp_path / "coded", "b.csv", "category,title,SOURCEURL,SQLDATE,ActionGeo_Lat,ActionGeo_Long\nprotest,Other,https://p.test/b,20250212,1,2\n")
    got = {r["info_url"][-1]: r for r in S.coded_events(S.read_coded(spark, path)).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["title"], got["a"]["summary"], got["a"]["geo_precision"], got["a"]["significance"]) == ('A "big" title', "two\nlines", "city", 100.0)
    assert (got["b"]["category"], got["b"]["lng"], got["b"]["significance"], got["b"]["weight"]) == ("protest", 2.0, 55.0, 0.0)


def test_first_feed_with_features(spark, tmp_path):
    feature = {"id": "u1", "properties": {"mag": 5.0, "time": 1791028800000, "tsunami": 1, "place": "Bay"}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}}
    empty, full = write(tmp_path / "e", "a.json", json.dumps({"features": []})), write(tmp_path / "f", "a.json", json.dumps({"features": [feature]}))
    found, path = S.first_with_features(spark, [empty, full, empty], S.QUAKE_SCHEMA)
    assert path == full and found.count() == 1
    assert S.first_with_features(spark, [empty], S.QUAKE_SCHEMA)[0].count() == 0
    quakes = S.quake_events(found)
    tags = K.tsunami_tags(quakes)
    assert [tuple(r) for r in tags.collect()] == [("usgs:u1", "tsunami", "keyword")]
    assert K.with_tags(tags, tags).count() == 1
    assert K.kind_rows(quakes, K.QUAKES).first().asDict()["magnitude"] == 5.0


def test_kind_tables_are_refreshed_by_their_rules(spark):
    detail = "struct<gdacs_event_id:long,episode_id:long,alert_level:string,alert_score:double,population:long,glide:string,name:string,severity_text:string,country:string,iso3:string,magnitude:double,max_wind_kmh:double,flood_severity_score:double,affected_area_km2:double,burned_area_ha:double>"
    events = lambda *rows: spark.createDataFrame(list(rows), f"event_id string, category string, detail {detail}")
    first = (1, 1, "Green", 1.0, 10, "g", "Old", "text", "A", "AAA", 5.0, 100.0, 1.0, 2.0, 3.0)
    later = (2, 2, "Red", 2.0, 20, "h", "New", "more", "B", "BBB", None, None, None, None, None)
    want = {
        "earthquake": {"gdacs_event_id": 2, "alert_level": "Red", "population": 20, "glide": "h", "magnitude": 5.0},
        "cyclone": {"gdacs_event_id": 1, "episode_id": 1, "glide": "g", "alert_level": "Red", "storm_name": "New", "storm_class": "more", "max_wind_kmh": None, "population": 20},
        "flood": {"gdacs_event_id": 1, "population": 10, "country": "A", "severity_text": "more", "flood_severity_score": None, "alert_score": 2.0},
        "drought": {"population": 10, "iso3": "AAA", "affected_area_km2": None, "alert_level": "Red"},
        "volcano": {"volcano_name": "New", "severity_text": "more", "population": 10, "country": "A"},
        "wildfire": {"gdacs_event_id": 2, "population": 20, "burned_area_ha": None},
    }
    for category, values in want.items():
        kind = K.ALERTS[category]
        stored = K.kind_rows(events(("x", category, first)), kind, category)
        incoming = K.kind_rows(events(("x", category, later), ("y", category, later), ("z", "other", later)), kind, category)
        rows = {r["event_id"]: r.asDict() for r in K.refreshed(stored, incoming, kind).collect()}
        assert set(rows) == {"x", "y"} and rows["y"]["gdacs_event_id"] == 2
        assert {k: rows["x"][k] for k in values} == values
    fires = spark.createDataFrame([("x", 3, 9.0, 4.0, "N", "n", "D", "Green")], "event_id string, hotspot_count long, max_frp double, mean_frp double, satellite string, confidence string, daynight string, alert_level string")
    again = spark.createDataFrame([("x", 5, 12.0, 6.0, "M", "h", "N")], "event_id string, hotspot_count long, max_frp double, mean_frp double, satellite string, confidence string, daynight string")
    row = K.refreshed(fires, again, K.FIRES).first()
    assert (row["hotspot_count"], row["max_frp"], row["satellite"], row["alert_level"]) == (5, 12.0, "N", "Green")


CONFLICT = ["event_id_cnty", "event_date", "event_type", "sub_event_type", "geo_precision", "fatalities", "tags", "civilian_targeting"]


def test_conflicts(spark):
    rows = [
        ("KLO7", "2025-02-11", "Battles", "Armed clash", "1", "0", "", ""),
        ("KLO8", "2025-02-12", "Protests", "Peaceful protest", "2", "0", "crowd size=around 40; sit-in", ""),
        ("KLO9", "2025-02-13", "Strategic developments", "Agreement", "3", "31", "", "Civilian targeting"),
        ("KLO10", "2025-02-13", "Rumour", "", "1", "0", "", ""),
        ("KLO11", "some day", "Battles", "Armed clash", "1", "0", "", ""),
    ]
    frame = spark.createDataFrame(rows, CONFLICT)
    same = {"disorder_type": "Political violence", "actor1": "Harbour Guard", "actor2": "Hill Militia", "latitude": "-7.5", "longitude": "31.25", "notes": "As reported.", "country": "Kalonia", "location": "Port Mira"}
    frame = frame.withColumns({k: F.lit(v) for k, v in same.items()})
    got = {r["source_event_id"]: r for r in S.conflict_events(frame).collect()}
    assert set(got) == {"KLO7", "KLO8", "KLO9"}
    clash, sit_in, pact = (got[k] for k in ("KLO7", "KLO8", "KLO9"))
    assert (clash["category"], clash["title"], clash["detail"]["event_type"], clash["lat"], clash["lng"]) == ("conflict", "Armed clash in Port Mira, Kalonia", "Battles", -7.5, 31.25)
    assert clash["entities"][0]["text"] == "Harbour Guard"
    tags = [t["tag"] for t in sit_in["tags"]]
    assert tags[0] == "Protests" and "crowd size=around 40" in tags and "fatalities" not in tags
    assert sit_in["detail"]["crowd_size"] == "around 40" and sit_in["geo_precision"] == "city"
    assert pact["geo_precision"] == "region" and pact["significance"] == 100 and ("fatalities", "impact") in {tuple(t) for t in pact["tags"]}


CODED = ["SQLDATE", "ActionGeo_FullName", "ActionGeo_Lat", "GoldsteinScale", "SOURCEURL", "category"]


def test_coded_events(spark):
    rows = [
        ("20250211", "Mira Sound, Oceans (general), Oceans", "-8.0", "-10.0", "https://paper.test/sea", "conflict"),
        ("20250212", "Port Mira, Kalonia", "-7.5", "0", "https://paper.test/march", "protest"),
        ("20250212", "Port Mira, Kalonia", "-7.5", "-2.0", "https://paper.test/theft", "crime"),
        ("20250212", "Port Mira, Kalonia", "", "-2.0", "https://paper.test/nowhere", "conflict"),
        ("20250212", "Port Mira, Kalonia", "-7.5", "-2.0", "https://paper.test/rain", "weather"),
        ("2025", "Port Mira, Kalonia", "-7.5", "-2.0", "https://paper.test/undated", "conflict"),
    ]
    frame = spark.createDataFrame(rows, CODED)
    same = {"Actor1Name": "COAST GUARD", "Actor2Name": "FISHERS", "EventCode": "172", "ActionGeo_Long": "31.0", "NumArticles": "12", "title": "A title", "description": "A description."}
    got = {r["source_event_id"].rsplit("/", 1)[1]: r for r in S.coded_events(frame.withColumns({k: F.lit(v) for k, v in same.items()})).collect()}
    assert set(got) == {"sea", "march", "theft"}
    sea = got["sea"]
    assert (sea["geo_precision"], sea["significance"], sea["weight"], sea["detail"]["actor1"]) == ("region", 100, 12, "COAST GUARD")
    assert str(sea["occurred_at"]) == "2025-02-11 00:00:00" and ("172", "keyword") in {tuple(t) for t in sea["tags"]}
    assert (got["march"]["geo_precision"], got["march"]["significance"]) == ("city", 55)
    assert got["theft"]["detail"] is None


def test_news_and_stories(spark, tmp_path):
    path = write(tmp_path / "n", "a.json", json.dumps([{"title": "T", "url": " https://n/1 ", "publishedAt": "2026-10-01T10:00:00Z", "source": {"name": "Paper"}, "_layerId": "sports"}, {"title": "No link", "publishedAt": "?"}]))
    rows = {r["title"]: r for r in S.article_events(spark.read.schema(S.NEWS_SCHEMA).option("multiLine", True).json(path), as_of()).collect()}
    assert rows["T"]["layer_id"] == "sports" and rows["T"]["links"][0]["source"] == "Paper" and str(rows["T"]["occurred_at"]) == "2026-10-01 10:00:00"
    assert rows["No link"]["links"] == [] and str(rows["No link"]["occurred_at"]) == AS_OF and rows["No link"]["layer_id"] == "news"
    day = {"news": [{"story": "<b>Fire</b> in town. More.", "links": [{"title": "A", "content_urls": {}}, {"title": "B", "titles": {"normalized": "Bee"}, "thumbnail": {"source": "https://t"}, "content_urls": {"desktop": {"page": "https://w/B"}}}]}, {"story": "<i></i>"}], "onthisday": [{"text": "Old"}]}
    past = {"onthisday": [{"text": "Long ago it happened", "pages": []}]}
    feed = write(tmp_path / "w", "a.json", json.dumps(day) + "\n" + json.dumps(past))
    got = S.story_events(spark.read.schema(S.STORY_SCHEMA).json(feed).withColumn("wiki_date", F.lit("2026-10-01"))).collect()
    assert sorted(r["title"] for r in got) == ["Fire in town.", "Long ago it happened"]
    fire = next(r for r in got if r["title"].startswith("Fire"))
    assert [tuple(x) for x in fire["links"]] == [("https://w/B", "wikipedia", "Bee")] and fire["image_url"] == "https://t"


def test_outlines_and_catalogue(spark, tmp_path):
    path = write(tmp_path / "o", "a.opml", '<opml><outline text="Group">\n<outline text="A &amp; B" xmlUrl="https://f/a?x=1&amp;y=2" />\n<outline title="C" text="c" xmlUrl="https://f/c">')
    assert [tuple(r) for r in S.read_outlines(spark, path).orderBy("title").collect()] == [("A & B", "https://f/a?x=1&y=2"), ("C", "https://f/c")]
    star = " " * 75 + "001230.0" + "-" + "451545" + " " * 12 + " 1.46" + "  " + "     "
    lost = " " * 120
    rows = S.catalog_stars(spark.createDataFrame([(star,), (lost,)], "value string")).collect()
    assert [tuple(r) for r in rows] == [(3.13, -45.26, 1.46, 0.6)]


def test_population_cells_are_read_and_summed(spark, tmp_path):
    # Five by five cells around the hazard; -200 is no data. The sum within 1.3 km is known.
    path = str(tmp_path / "pop")
    spark.createDataFrame([(0, 0, 0.0, 0.01, 30.0), (0, 0, 0.0, 0.0, 1000.0), (0, 0, 0.01, 0.0, -200.0), (0, 1, 0.5, 0.5, 70.0)], "tile_row int, tile_col int, lat double, lng double, pop double").write.parquet(path)
    cells = S.read_population(spark, path)
    circle = spark.createDataFrame([(0.0, 0.0, 1.3)], "lat double, lng double, radius_km double")
    assert E.people_in_radius(circle, cells).first()["people"] == 1030.0


def test_a_pull_is_recorded_and_named_by_its_rows(spark):
    batch = M.record_batch(spark, "usgs", as_of(), F.lit('{"kept": 2}')).first()
    assert (batch["source"], batch["payload"], str(batch["pulled_at"])) == ("usgs", '{"kept": 2}', AS_OF) and len(batch["batch_id"]) == 36
    row = M.with_lineage(spark.range(1), F.lit(batch["batch_id"])).first()
    assert row["raw_ref"] == f"raw.ingest_batch:{batch['batch_id']}"


def test_only_web_addresses_are_citations(spark):
    df = spark.createDataFrame([(["https://a", "notes", "http://b", None, ""],)], "c array<string>")
    assert df.select(FI.web_citations(F.col("c"))).first()[0] == ["https://a", "http://b"]
