"""Request feeds by blocks against a plain loop over all configs and events."""

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from geoevents.operators import personal as P
from geoevents.operators import requests as R

AS_OF = datetime(2024, 1, 31)
EVENTS = "id string, layer_id string, lat double, lng double, significance double, occurred_at timestamp_ntz, title string, terms array<string>"
CONFIGS = "user_id long, layers array<string>, keywords array<string>, coordinates array<struct<lat:double,lng:double>>, floor double"


def situation(seed):
    r = random.Random(seed)
    titles = ["Flood near Elm", "Big Storm", "storm surge near bay", "", "Music\tfestival"]
    events = [(f"e{i}", r.choice(["a", "b", None]), r.choice([None, 10.0, -40.5]), r.choice([0.0, 170.0]), r.choice([None, 5.0, 50.0, 120.0]), AS_OF - timedelta(hours=r.choice([1, 40, 160, 400])), r.choice(titles), r.choice([[], ["Rain"]])) for i in range(300)]
    # Copies beyond the length of a feed.
    events += [(f"c{i}", "a", 1.0, 1.0, 90.0, AS_OF, "Storm", []) for i in range(40)]
    words = [["storm"], ["near bay", "zzz"], [], None, ["Flood near", "rain"]]
    places = [[(10.0, 1.0)], [(0.0, -179.0), (None, 3.0)], [], None]
    configs = [(u, r.choice([["a"], ["a", "b", "a"], ["q"], None]), r.choice(words), r.choice(places), r.choice([0.0, 10.0, None])) for u in range(60)]
    return events, configs


def km(a, b):
    d = lambda x: math.radians(x)
    h = math.sin(d(b[0] - a[0]) / 2) ** 2 + math.cos(d(a[0])) * math.cos(d(b[0])) * math.sin(d(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def loop(events, configs, n):
    out = set()
    for user, layers, words, places, floor in configs:
        rows = []
        for id_, layer, lat, lng, significance, at, title, terms in events:
            age = (AS_OF - at).total_seconds() / 3600
            if layer not in (layers or []) or layer is None or significance is None or floor is None or significance < floor or age > 168:
                continue
            tokens = sorted(set(f"{title} {' '.join(terms)}".lower().split()))
            full = " ".join(tokens)
            hit = lambda k: 1.0 if k in full else 0.5 if set(k.split()) & set(tokens) else 0.0
            keyword = min(1.0, sum(hit(k.lower()) for k in words) / len(words)) if words else 0.5
            # An unknown place is half the world away.
            far = [km((lat, lng), p) if None not in (lat, lng, *p) else 20015.0 for p in places or []]
            near = max(0.0, 1 - min(far) / 5000) if far else 0.5
            recency = 1.0 if age <= 24 else 0.5 if age >= 168 else 1 - (age - 24) / 144 * 0.5
            rows.append((-round(0.3 * near + 0.4 * keyword + 0.2 * min(1.0, significance / 100) + 0.1 * recency, 6), id_))
        out |= {(user, id_, rank) for rank, (_, id_) in enumerate(sorted(rows)[:n], 1)}
    return out


def test_feeds_by_blocks_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(R.sieved, "__defaults__", (5, 64))
    for seed in range(2):
        events, configs = situation(seed)
        feed = P.keyword_feed(spark.createDataFrame(configs, CONFIGS), spark.createDataFrame(events, EVENTS), F.lit(AS_OF).cast("timestamp_ntz"), 8)
        assert {(r.user_id, r.id, r["rank"]) for r in feed.collect()} == loop(events, configs, 8)


def test_copies_are_cut_to_the_length_of_a_feed():
    same = {"lat": 1.0, "lng": 1.0, "significance": 9.0, "base": 0.1, "tokens": ["x"], "full": "x"}
    events = pa.Table.from_pylist([{"id": f"e{i:04}", **same} for i in range(2_000)])
    configs = pa.Table.from_pylist([{"asked": "q", "keywords": [{"phrase": "x", "parts": ["x"]}], "coordinates": [{"lat": 1.0, "lng": 1.0}], "floor": 0.0}])
    _, found = R.best_of_block(configs, events, 5)
    assert found.tolist() == [0, 1, 2, 3, 4]
