"""Hand-checked values of single expressions and small operators."""

import datetime as dt

import math
import random

import pytest
from pyspark.sql import functions as F

from geoevents.functions import arrays as Y
from geoevents.functions import geo as G
from geoevents.functions import score as M
from geoevents.functions import text as X
from geoevents.functions import times as C
from geoevents.operators import country as CO
from geoevents.operators import density as D
from geoevents.operators import exposure as EX
from geoevents.operators import filters as FI
from geoevents.operators import graph as GR
from geoevents.operators import links as LI
from geoevents.operators import merge as ME
from geoevents.operators import personal as P
from geoevents.operators import ranking as RA
from geoevents.operators import validate as VA


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def test_tiles(spark):
    at = lambda lat, lng: (one(spark, G.tile_row(F.lit(lat))), one(spark, G.tile_col(F.lit(lng))))
    assert at(52.0, 5.0) == (4, 19)
    assert at(-5.0, 115.0) == (10, 30)
    box = one(spark, G.tile_bounds(F.lit(10), F.lit(30)))
    assert box["west"] == pytest.approx(109.99208292, abs=1e-4) and box["north"] == pytest.approx(-0.90041646, abs=1e-4)
    tiles = {tuple(t) for t in one(spark, EX.tiles_covering(F.lit(0.0), F.lit(-179.5), F.lit(80.0)))}
    assert {(9, 1), (9, 36)} <= tiles


def test_population_sum_skips_no_data(spark):
    pops = {(2, 2): 1000, (1, 2): 10, (3, 2): 10, (2, 1): -200, (2, 3): 10, (1, 1): 999, (1, 3): 999, (3, 1): 999, (3, 3): 999}
    rows = [(20 - 0.01 * (r + 0.5), 10 + 0.01 * (k + 0.5), float(pops.get((r, k), 0))) for r in range(5) for k in range(5)]
    cells = spark.createDataFrame(rows, "lat double, lng double, pop double")
    circle = spark.createDataFrame([(19.975, 10.025, 1.3)], "lat double, lng double, radius_km double")
    assert EX.people_in_radius(circle, cells).first()["people"] == 1030


def test_impact(spark):
    label = lambda score, people: one(spark, M.impact_class(F.lit(float(score)), F.lit(people)))
    assert [label(s, 10_000) for s in (0, 24.9, 25, 49.9, 50, 74.9, 75, 100)] == ["Low", "Low", "Moderate", "Moderate", "High", "High", "Severe", "Severe"]
    assert (label(80, 499), label(80, 500), label(10, 0)) == ("Moderate", "Severe", "Low")
    assert one(spark, M.impact_score(F.lit(1.0), F.lit(5_000_000.0))) == pytest.approx(100)
    assert one(spark, M.impact_score(F.lit(1.0), F.lit(0.0))) == 0


def test_intensity(spark):
    null = F.lit(None).cast("double")

    def level(category, magnitude=None, frp=None, wind=None, alert=None):
        d = lambda x: null if x is None else F.lit(float(x))
        return one(spark, M.hazard_intensity(F.lit(category), d(magnitude), d(frp), d(wind), F.lit(alert).cast("string")))

    assert (level("earthquake", 4), level("earthquake", 10), level("earthquake")) == (0.5, 1.0, None)
    assert (level("wildfire", frp=25), level("wildfire", alert="Red"), level("wildfire")) == (0.5, 1.0, None)
    assert (level("flood", alert="Orange"), level("volcano", alert="green"), level("drought", alert="Red")) == (0.6, 0.25, None)
    assert (level("cyclone", wind=100, alert="Red"), level("cyclone", alert="Green")) == (0.5, 0.25)


def test_conflict_scores(spark):
    score = lambda deaths, aim: one(spark, M.conflict_significance(F.lit(deaths), F.lit(aim).cast("string")))
    assert (score(0, None), score(1, None), score(12, "Civilian targeting")) == (55, 60, 100)
    gold = lambda text: one(spark, M.goldstein_significance(F.lit(text)))
    assert (gold("-9"), gold("-10"), gold("0"), gold("")) == (95.5, 100, 55, 55)
    place = lambda text: one(spark, M.geo_precision_from_place(F.lit(text)))
    assert (place("Baltic Sea, Oceans (general), Oceans"), place("Helsinki, Finland"), place("Finland")) == ("region", "city", "region")


def test_urls_and_text(spark):
    url = lambda text: one(spark, X.canonical_url(F.lit(text)))
    assert url("HTTPS://News.Example.com/a/b?utm_source=x&id=7&fbclid=y#top") == "https://news.example.com/a/b?id=7"
    assert url("https://example.com/story") == "https://example.com/story"
    assert url("https://e.com/?q=a b&empty=&x=%7Ehome*") == "https://e.com/?q=a+b&empty=&x=~home%2A"
    clean = lambda text, limit=None: one(spark, X.clean_text(F.lit(text), limit))
    assert clean("<p>Hello&nbsp;<b>world</b></p>") == "Hello world"
    assert clean("one two three four", 9) == "one two…"
    assert clean("&eacute;&#233;&lt;b&gt;") == "éé<b>"
    assert one(spark, X.site_domain(F.lit("https://www.m.example.org:8080/x"))) == "example.org"
    assert one(spark, X.first_sentence(F.lit("It rained. A lot."))) == "It rained."
    assert one(spark, X.crowd_size(F.lit("x; crowd size= about 50; y"))) == "about 50"


def test_entities_without_semicolon(spark):
    clean = lambda text, closed: one(spark, X.clean_text(F.lit(text), closed=closed))
    assert clean("the&amp</title> &quot;a&#34; &nosuch; &amp;quot;", True) == 'the&amp "a" &nosuch; &quot;'
    assert clean("the&amp</title>", False) == "the&"


def test_junk(spark):
    reason = lambda title, link: one(spark, FI.junk_reason(F.lit(title), F.lit(link)))
    assert reason("Your horoscope for today", "https://x.com/a") == "junk title"
    assert reason("Election results", "https://x.com/sponsored/123") == "junk path"
    assert reason("Floods hit the coast", "https://x.com/news/1") is None
    assert reason("Deals struck at the summit", "https://x.com/news/2") is None


@pytest.mark.parametrize("when, label", [
    ("2026-10-04 15:29:30", "Just now"), ("2026-10-04 15:28:00", "2 min ago"), ("2026-10-04 12:10:00", "3 h ago"), ("2026-10-03 12:10:00", "Yesterday"),
    ("2026-10-01 12:10:00", "3 days ago"), ("2026-09-20 12:10:00", "Sep 20"), ("2025-09-20 12:10:00", "Sep 20, 2025"), ("2026-10-04 15:33:00", "Just now"),
    ("2026-10-09 09:00:00", "Oct 9"), ("2026-10-04 00:00:00", "Today"), ("2026-10-03 00:00:00", "Yesterday"), ("2026-09-30 00:00:00", "Sep 30"), (None, "")])
def test_freshness(spark, when, label):
    assert one(spark, C.freshness_label(stamp(when), stamp("2026-10-04 15:30:00"))) == label


def test_imagery_day_and_frame(spark):
    now = stamp("2026-10-04 17:00:00")
    assert one(spark, C.imagery_day(stamp("2026-10-04 03:00:00"), now)) == dt.date(2026, 10, 3)
    assert one(spark, C.imagery_day(stamp("2026-10-01 12:00:00"), now)) == dt.date(2026, 10, 1)
    frame = one(spark, G.image_frame(F.lit(0.0), F.lit(10.0), F.lit(25.0)))
    assert frame["north"] == pytest.approx(0.3378, abs=1e-3) and frame["west"] == pytest.approx(9.6622, abs=1e-3) and frame["height"] == 512


def _detail(spark, **given):
    kinds = {"magnitude": "double", "depth_km": "double", "max_wind_kmh": "double", "max_frp": "double", "hotspot_count": "int", "felt": "int", "burned_area_ha": "double", "tsunami": "boolean"}
    names = ["magnitude", "mag_type", "depth_km", "alert", "alert_level", "tsunami", "felt", "max_wind_kmh", "max_frp", "hotspot_count", "daynight", "burned_area_ha", "country", "actor1", "actor2", "location"]
    return F.struct(*[F.lit(given.get(n)).cast(kinds.get(n, "string")).alias(n) for n in names])


def test_vital_signs(spark):
    def signs(layer, source, **given):
        return [(s["value"], s["label"], s["tone"]) for s in one(spark, Y.vital_signs(F.lit(layer), F.lit(source), _detail(spark, **given)))]

    assert signs("earthquake", "usgs", magnitude=5.9, mag_type="mww", depth_km=24.4, alert="yellow", tsunami=True, felt=1200) == [
        ("M 5.9", "magnitude (mww)", None), ("24 km", "depth", None), ("Possible", "tsunami", "orange")]
    assert signs("cyclone", "gdacs", max_wind_kmh=212.96, alert_level="Orange") == [("213 km/h", "max wind", None), ("Orange", "alert", "orange")]
    assert signs("wildfire", "firms", max_frp=46.2, hotspot_count=1, daynight="N") == [("46 MW", "peak fire power", None), ("1", "hotspot", None), ("Night", "detected", None)]
    assert signs("protest", "conflict_csv", actor1="POLICE", actor2="PROTESTER", location="India") == [("Police", "side A", None), ("Protester", "side B", None), ("India", "location", None)]
    assert signs("news", "gnews") == []
    assert signs("earthquake", "usgs", alert="purple") == []
    assert one(spark, X.impact_label(F.lit("High"), F.lit(12000), F.lit(25.0))) == "High impact · 12,000 people within 25 km · JRC GHSL"
    assert one(spark, X.impact_label(F.lit(None).cast("string"), F.lit(1), F.lit(1.0))) is None


def test_chips_and_place(spark):
    rows = [([("POLICE", "actor", None, 1.0)],
             [("Lisbon", "location", .9, None), ("housing", "topic", .95, None), ("Ana Costa", "person", .7, None), ("Porto", "location", .8, None), ("HOUSING", "concept", .5, None)])]
    kind = "array<struct<text:string,type:string,relevance:double,confidence:double>>"
    story = spark.createDataFrame(rows, f"entities {kind}, keywords {kind}")
    null = F.lit(None).cast("string")
    place = Y.place_label(null, null, null, F.col("keywords"))
    row = story.select(place.alias("place"), Y.chips(F.col("entities"), F.col("keywords"), place).alias("chips"), Y.chips(F.col("entities"), F.col("keywords"), place, 2).alias("two")).first()
    assert row["place"] == "Lisbon"
    assert [tuple(c) for c in row["chips"]] == [("Ana Costa", "person"), ("Police", "actor"), ("Porto", "place"), ("housing", "topic")]
    assert len(row["two"]) == 2


def test_headlines(spark):
    rows = [("c1", "conflict", 100.0), ("c2", "crime", 99.0), ("c3", "terror", 98.0), ("c4", "protest", 97.0), ("p1", "politics", 60.0), ("f1", "finance", 50.0), ("s1", "sports", 10.0)]
    events = spark.createDataFrame(rows, "id string, layer_id string, significance double")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(RA.headline_feed(events, 5, 3)) == ["c1", "c2", "c3", "p1", "f1"]
    assert ids(RA.headline_feed(events, 7, 3)) == ["c1", "c2", "c3", "c4", "p1", "f1", "s1"]
    assert ids(RA.headline_feed(events.limit(4), 4, 2)) == ["c1", "c2", "c3", "c4"]
    assert ids(RA.headline_feed(events.limit(0), 5, 3)) == []


def test_polygon_with_hole_boundary_and_dateline(spark):
    ring = lambda part, number, box: [("X", part, number, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(box, box[1:]))]
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    rows = ring(0, 0, square(0, 0, 10, 10)) + ring(0, 1, square(3, 3, 7, 7)) + ring(1, 0, square(170, 0, 180, 5))
    edges = spark.createDataFrame(rows, "country_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    points = [(5.0, 1.0), (5.0, 5.0), (0.0, 0.0), (10.0, 10.0), (3.0, 5.0), (11.0, 5.0), (2.0, 175.0), (2.0, -185.0), (2.0, 195.0)]
    found = {(r["lat"], r["lng"]) for r in CO.containing(spark.createDataFrame(points, "lat double, lng double"), edges).collect()}
    assert found == {(5.0, 1.0), (0.0, 0.0), (10.0, 10.0), (2.0, 175.0), (2.0, -185.0)}


def test_country_chain(spark):
    square = lambda c, w, s, e, n: [(c, 0, 0, i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip([(w, s), (e, s), (e, n), (w, n)], [(e, s), (e, n), (w, n), (w, s)]))]
    edges = spark.createDataFrame(square("GBR", 0, 50, 5, 55) + square("USA", -100, 30, -80, 45), "country_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    countries = spark.createDataFrame([("GBR", "United Kingdom", 0), ("USA", "United States of America", 1)], "country_id string, name string, position int")
    rows = [("under", 52.0, 1.0, "USA", None, []), ("stated", 0.0, 0.0, "USA", None, []), ("named", 0.0, 0.0, None, "Leeds (city), England", []), ("keyword", 0.0, 0.0, None, None, ["21 km off Here, USA"]),
            ("coast", 52.0, 6.5, None, None, []), ("far", 52.0, 20.0, None, None, []), ("sea", 52.0, 6.5, None, "Baltic Sea, Oceans", [])]
    events = spark.createDataFrame(rows, "id string, lat double, lng double, country_iso3 string, location string, place_keywords array<string>")
    got = {r["id"]: (r["country_id"], r["found"]) for r in CO.event_country(events, edges, countries).collect()}
    assert got == {"under": ("GBR", "under"), "stated": ("USA", "stated"), "named": ("GBR", "named"), "keyword": ("USA", "named"), "coast": ("GBR", "coast"), "far": (None, None), "sea": (None, None)}


def test_density(spark):
    assert D.segments(3) == (420, 210) and D.segments(1.5) == (840, 420)
    point = spark.createDataFrame([("a", 0.0, 179.0, 1.0)], "g string, lat double, lng double, weight double")
    field = D.density_field(point, "g", 6.0)
    assert field.agg(F.max("density")).first()[0] == 1.0
    width, _ = D.segments(6.0)
    columns = {r["col"] for r in field.select("col").distinct().collect()}
    assert 0 in columns and width - 1 in columns, "reaches across the dateline"
    # Tiles and their shares are only a way to work it out.
    rng = random.Random(3)
    spots = [(rng.choice("ab"), rng.choice([0.0, 89.0, -89.5, rng.uniform(-90, 90)]), rng.choice([179.9, -179.9, rng.uniform(-180, 180)]), rng.choice([1.0, 2.0, -0.5])) for _ in range(60)]
    want = {}
    for g, lat, lng, w in spots:
        for row in range(D.segments(12.0)[1] + 1):
            for col in range(D.segments(12.0)[0]):
                p, q = math.radians(lat), math.radians(90 - row * 180 / D.segments(12.0)[1])
                d = math.radians(col * 360 / D.segments(12.0)[0] - 180 - lng)
                angle = 2 * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)))
                if angle < math.radians(48.0):
                    want[g, row, col] = want.get((g, row, col), 0.0) + w * math.exp(-((angle / math.radians(12.0)) ** 2) / 2)
    points = spark.createDataFrame(spots, "g string, lat double, lng double, weight double")
    for size, share in ((D.TILE, D.TILE_POINTS), (16, 3)):
        got = {(r["g"], r["row"], r["col"]): r["raw"] for r in D.density_field(points, "g", 12.0, size, share).collect()}
        assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert D.density_field(points.limit(0), "g", 12.0).collect() == []


def test_locality(spark):
    verdict = lambda about: tuple(one(spark, LI.locality(F.lit(about).cast("string"), F.lit("IRL"))))
    assert verdict("irl") == ("IRL", True, None)
    assert verdict("GBR") == ("GBR", False, "about GBR, publisher in IRL")
    assert verdict("") == (None, False, "international story, no single country")
    assert verdict(None)[2] == "international story, no single country"


def test_link_answers(spark):
    kind = "news_id string, disaster_id string, relationship boolean, type string, confidence double, mechanism string, evidence array<string>"
    good = ("n", "d", True, "PRIMARY_STORY", 0.9, "Report covers the earthquake and its damage", ["quote"])
    rows = [good, ("n", "d2", True, "MENTIONS", 0.9, "Both happened in the same region last week", ["q"]), ("n", "d3", True, "MENTIONS", 0.2, good[5], ["q"]),
            ("n", "d4", True, "MENTIONS", 0.9, "too short", ["q"]), ("n", "d5", True, "MENTIONS", 0.9, good[5], []), ("n", "d6", False, "MENTIONS", 0.9, good[5], ["q"])]
    kept = LI.news_disaster_links(spark.createDataFrame(rows, kind)).collect()
    assert [(r["link_id"], r["relation"], r["display"]) for r in kept] == [("link:n:d", "primary-story", "merge")]


def test_row_rules(spark):
    kind = "id string, layer_id string, title string, lat double, lng double"
    rows = spark.createDataFrame([("a", "news", "t", 1.0, 1.0), ("b", "weather", "t", 95.0, 1.0), ("c", "news", None, 1.0, 1.0)], kind)
    good, broken = VA.quarantine(rows)
    assert [r["id"] for r in good.collect()] == ["a"]
    assert {r["id"]: r["violations"] for r in broken.collect()} == {"b": ["lat", "layer_id"], "c": ["title"]}
    assert VA.reject_batch(good).count() == 1
    with pytest.raises(ValueError, match="row b violates the contract at lat"):
        VA.reject_batch(rows)


def test_links_as_seen_from_their_page(spark):
    base = "https://h.test/a/b/page?x=1#top"
    want = {
        "../c.png": "https://h.test/a/c.png", "./c.png": "https://h.test/a/b/c.png", "c/../d.png?q=../x": "https://h.test/a/b/d.png?q=../x", "../../../c": "https://h.test/c", "?y=2": "https://h.test/a/b/page?y=2",
        "#low": "https://h.test/a/b/page?x=1#low", "/r/./s": "https://h.test/r/s", "//o.test/z": "https://o.test/z", "http://q.test/": "http://q.test/", "plain.png": "https://h.test/a/b/plain.png", "..": "https://h.test/a/",
    }
    rows = spark.createDataFrame([(k,) for k in want], "link string").select("link", X.absolute_url(F.lit(base), F.col("link")).alias("full")).collect()
    assert {r["link"]: r["full"] for r in rows} == want


def test_repeated_new_keys_give_one_row(spark):
    stored = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 2, None), ("a", 3, None), ("b", 4, "y"), ("b", 5, "z")], "k string, v int, w string")
    got = sorted(map(tuple, ME.upsert_partial(stored, new, ["k"], replace=["v"], keep_if_null=["w"], order=F.col("v")).collect()))
    assert got == [("a", 3, "x"), ("b", 5, "z")]
    assert sorted(map(tuple, ME.insert_absent(stored, new, ["k"], F.col("v")).collect())) == [("a", 1, "x"), ("b", 4, "y")]


def test_rerank_keeps_every_rank(spark):
    feed = spark.range(1, 1501).select(F.lit("u").alias("user_id"), F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("rank"))
    out = P.rerank_merge(feed, spark.createDataFrame([("u", "3", 1)], "user_id string, id string, rank int"))
    assert out.count() == 1500 and out.filter("id = '3'").first()["place"] == 1


def test_long_chains_settle_without_a_round_limit(spark):
    # Each event shares a URL with the next: two are settled per round.
    events = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("prio"), F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("urls"))
    assert sorted(int(r["id"]) for r in GR.url_dedup(events).collect()) == list(range(0, 40, 2))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert ME.read_version(spark, root) is None
    ME.write_version(spark.range(3), root, {"note": "x"})
    ME.write_version(spark.range(5), root)
    assert ME.read_version(spark, root).count() == 5
    assert ME.current_version(spark, root) == {"version": 2, "eventCount": 5}
    with pytest.raises(FileNotFoundError):
        ME.load_first(spark, [root + "-no"])
    assert ME.load_first(spark, [root + "-no", root])[1] == root


def test_lines_follow_the_great_circle(spark):
    kind = "lng1 double, lat1 double, lng2 double, lat2 double"
    line = lambda *p: CO.densify_lines(spark.createDataFrame([tuple(map(float, p))], kind), 1.5).orderBy("k").collect()
    arc = line(-30, 60, 30, 60)
    assert len(arc) > 2 and max(p["point_lat"] for p in arc) > 63
    seam = line(179, 30, -179, 30)
    assert seam and all(abs(p["point_lng"]) >= 179 for p in seam)
    assert line(0, 0, 1, 0) == []


def test_chips_are_worked_out_once(spark):
    from geoevents.plans import registry

    registry.load()
    plan = registry.QUERIES["chips"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The filter on the result repeated the whole expression.
    assert plan.count("array_sort(") == 1
