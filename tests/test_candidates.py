"""Factorised candidates, expanded, against the pairs of plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoevents.operators import candidates as C
from geoevents.operators import pairs as P

HOUR = 3_600_000_000


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def articles(seed, n):
    """A third are copies with one keyword set; some share times, some have no keywords."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["flood", "Storm", "rain"] if i % 3 == 0 else r.sample(["flood", "storm", "rain", "vote", "court", "match"], r.randrange(0, 4))
        rows.append((f"n{i:03d}", r.choice(["a", "b"]), r.randrange(0, 40) * 6 * HOUR, r.choice([10.0, 10.5, 40.0]), r.choice([20.0, 21.0]), words))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_one_rule_for_each_pair(spark, seed):
    rows = articles(seed, 70)
    want = {}
    for a in rows:
        for b in rows:
            if not (a[2] > b[2] or a[2] == b[2] and a[0] < b[0]):
                continue
            ka, kb = {w.lower() for w in a[5]}, {w.lower() for w in b[5]}
            lag = a[2] - b[2]
            if ka and kb and len(ka & kb) / len(ka | kb) >= 0.4:
                want[a[0], b[0]] = "keyword"
            elif km(a[3:5], b[3:5]) < 200 and lag < 48 * HOUR:
                want[a[0], b[0]] = "place"
            elif a[1] == b[1] and lag < 72 * HOUR:
                want[a[0], b[0]] = "topic"
    news = spark.createDataFrame(rows, "id string, category string, t_us bigint, lat double, lng double, keywords array<string>")
    c = C.news_candidates(news)
    got = [((r["id_a"], r["id_b"]), r["rule"]) for r in C.candidates_of(c, news).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    counts = {r["id"]: (r["keyword"], r["place"], r["topic"]) for r in C.candidate_counts(c).collect()}
    assert counts == {i[0]: tuple(sum(1 for (a, _), rule in want.items() if a == i[0] and rule == name) for name in ("keyword", "place", "topic")) for i in rows}
    few = C.candidates_of(c, news.filter("id < 'n005'"))
    assert {(r["id_a"], r["id_b"]) for r in few.collect()} == {p for p in want if p[0] < "n005"}


def test_a_pile_of_copies_costs_rows_not_pairs(spark):
    n = 600
    news = spark.range(n).select(F.format_string("n%04d", "id").alias("id"), F.lit("a").alias("category"), (F.col("id") * HOUR).alias("t_us"), (F.col("id") % 2 * 60.0).alias("lat"), F.lit(0.0).alias("lng"), F.array(F.lit("x"), F.lit("y")).alias("keywords"))
    # Far apart in time for the place rule: only every 100th is kept.
    c = C.news_candidates(news.filter("t_us % 360000000000 = 0"))
    assert c.keyword.count() == 5 and C.candidate_counts(c).agg(F.sum("keyword")).first()[0] == 15


@pytest.mark.parametrize("seed", range(2))
def test_batches_hold_all_candidates(spark, seed):
    r = random.Random(seed)
    kinds = ["flood", "earthquake"]
    disasters = [(f"d{i:03d}", 10.0 + r.random() * 20, 20.0, r.randrange(0, 400) * HOUR, r.choice(kinds)) for i in range(80)]
    news = [(f"n{i:02d}", 10.0 + r.random() * 20, 20.0, r.randrange(0, 400) * HOUR, r.choice(["a flood came", "an earthquake and a flood", "nothing"])) for i in range(25)]
    want = {}
    for n in news:
        found = []
        for d in disasters:
            if 0 <= n[3] - d[3] <= 168 * HOUR:
                named = d[4] in n[4]
                if named or km(n[1:3], d[1:3]) <= 500:
                    found.append(((1, "", -d[3], d[0]) if not named else (0, d[4], d[3], d[0])))
        if found:
            want[n[0]] = [x[3] for x in sorted(found)]
    ds = spark.createDataFrame(disasters, "id string, lat double, lng double, t_us bigint, category string")
    ns = spark.createDataFrame(news, "id string, lat double, lng double, t_us bigint, said string")
    c = C.disaster_candidates(ns, ds, P.news_disaster_pairs(ns, ds))
    got = {}
    for x in C.batches_of(c, ns.withColumnRenamed("id", "news_id"), 4).orderBy("news_id", "no").collect():
        got.setdefault(x["news_id"], []).append(x["disaster_id"])
        assert x["batch"] == x["no"] // 4 and x["no"] == len(got[x["news_id"]]) - 1
    assert got == want
    runs = C.candidate_runs(c, 4).collect()
    assert sum(x["n"] for x in runs) == sum(map(len, want.values()))
    assert all(x["last_batch"] == (x["first_no"] + x["n"] - 1) // 4 for x in runs)


def test_place_pairs_carry_no_keywords(spark):
    words = {"a": ["x1", "x2", "x3", "x4"], "b": ["X1", "x2", "x3", "x4"], "c": ["x1", "x2", "x3", "y"], "d": [], "e": ["z"], "f": None}
    news = spark.createDataFrame([(i, "k" if i < "d" else "q", n, 1.0, 1.0, w) for n, (i, w) in enumerate(words.items())], "id string, category string, t_us long, lat double, lng double, keywords array<string>")
    keyed = P.token_sets(news.select("id", P.lowered("keywords")), F.col("keywords"))
    sets = P.distinct_sets(keyed)
    near = P.news_place_pairs(news, keyed.select("id", "set_id"), sets, P.similar_sets(sets, P.KEYWORD_JACCARD), ("category",))
    assert not any("keywords" in c or "tokens" in c for c in near.columns)
    alike = {("a", "b"), ("a", "c"), ("b", "c")}
    assert {tuple(sorted((r.id_a, r.id_b))) for r in near.collect()} == {(x, y) for x in words for y in words if x < y} - alike
    counts = {r.id: (r.keyword, r.place, r.topic) for r in C.candidate_counts(C.news_candidates(news)).collect()}
    assert counts == {"a": (0, 0, 0), "b": (1, 0, 0), "c": (2, 0, 0), "d": (0, 3, 0), "e": (0, 4, 0), "f": (0, 5, 0)}


def test_bitmap_never_exceeds_the_difference(spark):
    sets = [[f"w{(i * 7 + j * k) % 90}" for j in range(30)] for k, i in enumerate(range(20), 1)]
    rows = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "id string, words array<string>").select("id", F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("token"))).alias("ranked"), "words")
    maps = {r.id: (set(r.words), [r[f"b{k}"] for k in range(P.BITMAPS)]) for r in rows.select("id", "words", *[P.bitmap("ranked", k).alias(f"b{k}") for k in range(P.BITMAPS)]).collect()}
    bits = lambda x: bin(x & (1 << 64) - 1).count("1")
    assert all(sum(bits(p ^ q) for p, q in zip(a[1], b[1])) <= len(a[0] ^ b[0]) for a in maps.values() for b in maps.values())
    assert all(0 < sum(map(bits, m)) <= len(s) for s, m in maps.values())


def disaster_tables(spark):
    news = spark.createDataFrame([("n1", 1.0, 1.0, 5 * HOUR, "a flood")], "id string, lat double, lng double, t_us long, said string")
    return news, spark.createDataFrame([("d1", 1.0, 1.1, 0, "flood"), ("d2", 1.0, 1.2, HOUR, "volcano")], "id string, lat double, lng double, t_us long, category string")


def test_disaster_pairs_are_joined_once(spark):
    news, hazards = disaster_tables(spark)
    near = P.news_disaster_pairs(news, hazards)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(near) == 1
    assert {(r.disaster_id, r.mentions) for r in near.collect()} == {("d1", True), ("d2", False)}


def test_runs_need_no_second_join(spark):
    news, hazards = disaster_tables(spark)
    c = C.disaster_candidates(news, hazards, P.news_disaster_pairs(news, hazards))
    assert c.near._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [(r.disaster_id, r.t_us) for r in c.near.collect()] == [("d2", HOUR)]


def test_batches_move_pairs_once(spark):
    rows = spark.range(25).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("item"), "id")
    out = P.batches(rows, "k", "item", [F.desc("id")], 10)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["k"], r.batch): list(r["items"])[0] for r in out.collect()} == {(0, 0): "24", (0, 1): "4", (1, 0): "23", (1, 1): "3"}
