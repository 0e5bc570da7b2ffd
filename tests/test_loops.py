"""Rewrites against the plain loops they replace, on random small inputs, with hot keys included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoevents.operators import graph as GR
from geoevents.operators import pairs as PA
from geoevents.operators import personal as PE
from geoevents.operators import ranking as RA
from geoevents.operators import skew as SK
from geoevents.schema import LAYER_CATEGORY, LAYERS

DAY = 24 * 3_600_000_000


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def points(n, seed):
    """A third on one spot, some at the poles and on both sides of the dateline."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 6
        lat, lng = (10.0, 20.0) if kind < 2 else (r.uniform(84, 90) * r.choice([-1, 1]), r.uniform(-180, 180)) if kind == 2 else (r.uniform(-5, 5), r.choice([-1, 1]) * r.uniform(178, 180)) if kind == 3 else (r.uniform(-70, 70), r.uniform(-180, 180))
        rows.append((f"p{i:04d}", lat, lng, r.randrange(0, 10 * DAY)))
    return rows


@pytest.mark.parametrize("radius, hours", [(500.0, 72), (200.0, 24)])
def test_near_pairs(spark, radius, hours):
    rows = points(400, 1)
    want = set()
    for a in rows:
        for b in rows:
            lag = a[3] - b[3]
            if 0 <= lag <= hours * 3_600_000_000 and (lag > 0 or a[0] < b[0]) and km(a[1:3], b[1:3]) <= radius:
                want.add((a[0], b[0]))
    df = spark.createDataFrame(rows, "id string, lat double, lng double, t_us bigint")
    got = [(r["id_a"], r["id_b"]) for r in PA.near_pairs(df, radius, hours).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("n_left", "n_right", "rows", "work"), [(300, 300, 20, 10**6), (300, 300, 1000, 400), (900, 30, 1000, 300), (30, 900, 50, 300), (5, 5, 1, 1)])
def test_split_join_meets_every_pair_once(spark, n_left, n_right, rows, work):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 50).alias("k")
    left, right = spark.range(n_left).select(F.col("id").alias("a"), key), spark.range(n_right).select(F.col("id").alias("b"), key)
    split = SK.block_join(left, right, ["k"], "b", "a", rows, work)
    pairs = [(r["a"], r["b"]) for r in split.select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) == left.join(right, "k").count()


def test_a_pile_is_cut_into_blocks_of_bounded_work(spark):
    # A pile of 100,000 probe and 100 build rows, and one that is long on both sides.
    pile = lambda n, k: spark.range(n).select(F.lit(k).alias("k"), F.col("id"))
    probe = pile(100_000, 1).union(pile(30_000, 2)).union(pile(10, 3)).withColumnRenamed("id", "a")
    build = pile(100, 1).union(pile(20_000, 2)).union(pile(10, 3)).withColumnRenamed("id", "b")
    hot = SK.rectangles(probe, build, ["k"], rows=20_000, work=1_000_000).cache()
    assert {r["k"]: (r["probe_splits"], r["build_splits"]) for r in hot.collect()} == {1: (10, 1), 2: (30, 20)}
    blocks = ["k", "_probe_stripe", "_build_stripe"]
    sizes = lambda df, n: df.groupBy(*blocks).agg(F.count(F.lit(1)).alias(n))
    met = sizes(SK.dealt(probe, hot, ["k"], "a", "probe", "build"), "p").join(sizes(SK.dealt(build, hot, ["k"], "b", "build", "probe"), "b"), blocks)
    rows = met.collect()
    assert len(rows) == 10 + 600 + 1
    assert sum(r["p"] * r["b"] for r in rows) == 100_000 * 100 + 30_000 * 20_000 + 100
    # Hashes deal evenly, so no block is far above its share.
    assert max(r["p"] * r["b"] for r in rows) < 1.3 * 1_000_000


def test_piles_on_one_spot_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(SK.block_join, "__defaults__", (7, 40))
    rng = random.Random(11)
    rows = [(f"e{i}", 10.0, 20.0, rng.randrange(3) * 3_600_000_000) for i in range(60)] + [(f"f{i}", 10.0 + rng.random() * 8, 20.0, rng.randrange(100) * 3_600_000_000) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, lat double, lng double, t_us bigint")
    want = {(a[0], b[0]) for a in rows for b in rows if 0 <= a[3] - b[3] <= 48 * 3_600_000_000 and (a[3] > b[3] or a[0] < b[0]) and km(a[1:3], b[1:3]) <= 200}
    got = [(r["id_a"], r["id_b"]) for r in PA.near_pairs(df, 200.0, 48).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_numbering_without_gathering_a_group(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"), ((F.col("id") * 37) % 101).alias("v"))
    got = {r["id"]: r["rn"] for r in SK.numbered_within(rows, ["k"], [F.desc("v"), F.asc("id")]).collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        want[r["id"]] = seen[r["k"]]
    assert got == want


def _sets(n, seed):
    r = random.Random(seed)
    base = [r.sample(range(60), r.randrange(1, 9)) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        # A third of the rows are copies of one set; the word 0 is in most sets.
        s = base[0] if i % 3 == 0 else base[i % len(base)][:] + ([r.randrange(60)] if i % 2 else [])
        rows.append((f"r{i:03d}", [f"w{x}" for x in dict.fromkeys([0] * (i % 4 > 0) + list(s))], r.randrange(0, 4 * DAY)))
    return rows


@pytest.mark.parametrize("threshold", [0.4, 0.5, 1.0])
def test_similar_rows(spark, threshold):
    rows = _sets(150, 3)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a[0], b[0]) for a in rows for b in rows if 0 <= a[2] - b[2] <= DAY and (a[2] > b[2] or a[0] < b[0]) and a[0] != b[0] and jaccard(a[1], b[1]) >= threshold}
    df = spark.createDataFrame(rows, "id string, words array<string>, t_us bigint")
    got = [(r["id_a"], r["id_b"]) for r in PA.similar_rows(df, F.col("words"), threshold, DAY).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_groups_stand_for_all_pairs(spark):
    rows = _sets(90, 5)
    df = spark.createDataFrame(rows, "id string, words array<string>, t_us bigint")
    total = sum(r["n_a"] * r["n_b"] if r["group_a"] != r["group_b"] else r["n_a"] * (r["n_a"] - 1) // 2 for r in PA.similar_groups(df, F.col("words"), 0.5).collect())
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert total == sum(jaccard(a[1], b[1]) >= 0.5 for i, a in enumerate(rows) for b in rows[i + 1:])


@pytest.mark.parametrize("seed", range(3))
def test_fair_pick(spark, seed):
    r = random.Random(seed)
    rows = [(f"i{n:03d}", r.choice("XY"), "big" if n % 3 == 0 else f"p{r.randrange(6)}", None if r.random() < .15 else r.randrange(10_000_000)) for n in range(90)]
    want = []
    for country in "XY":
        groups = {}
        for row in rows:
            if row[1] == country:
                groups.setdefault(row[2], []).append(row)
        newest = lambda x: (x[3] is None, -(x[3] or 0), x[0])
        queues = [sorted(g, key=newest) for g in groups.values()]
        queues.sort(key=lambda q: (q[0][3] is None, -(q[0][3] or 0), q[0][2]))
        picked = []
        while len(picked) < 12 and any(queues):
            for q in queues:
                if q and len(picked) < 12:
                    picked.append(q.pop(0)[0])
        want += picked
    df = spark.createDataFrame(rows, "item_id string, country string, publisher_id string, published_at int")
    assert [x["item_id"] for x in RA.fair_pick(df, 12).orderBy("country", "pick").collect()] == want


@pytest.mark.parametrize("seed", range(2))
def test_publisher_cap(spark, seed):
    r = random.Random(seed)
    best = {}
    for _ in range(120):
        k = (r.randrange(6), f"d{r.randrange(40)}")
        best[k] = max(best.get(k, 0), r.randrange(1, 1000))
    want, used = set(), set()
    for country in range(6):
        mine = sorted(((items, d) for (cc, d), items in best.items() if cc == country and d not in used), key=lambda x: (-x[0], x[1]))[:4]
        used |= {d for _, d in mine}
        want |= {(country, d) for _, d in mine}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in best.items()], "country_pos int, domain string, items int")
    assert {(x["country_pos"], x["domain"]) for x in RA.publisher_cap(df, 4).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_first_kept(spark, seed):
    r = random.Random(seed)
    # One URL is shared by a third of the events.
    rows = [(i, i, ["u0"] * (i % 3 == 1) + [f"u{r.randrange(1, 50)}" for _ in range(r.randrange(0, 3))]) for i in range(120)]
    seen, kept = set(), set()
    for i, _, urls in rows:
        if not set(urls) & seen:
            seen |= set(urls)
            kept.add(i)
    df = spark.createDataFrame(rows, "id int, prio int, urls array<string>")
    assert {x["id"] for x in GR.url_dedup(df).collect()} == kept


@pytest.mark.parametrize("seed", range(2))
def test_greedy_independent_and_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(70)] + [(0, x) for x in range(1, 27)] + [(x, x + 1) for x in range(60, 79)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    order = list(range(80))
    r.shuffle(order)
    kept = set()
    for x in sorted(range(80), key=lambda i: order[i]):
        if not near.get(x, set()) & kept:
            kept.add(x)
    nodes = spark.createDataFrame([(i, order[i]) for i in range(80)], "id int, prio int")
    df = spark.createDataFrame(edges, "a int, b int")
    assert {x["id"] for x in GR.greedy_independent(nodes, df).collect()} == kept
    parent = list(range(80))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges for x in e}
    assert {x["id"]: x["root"] for x in GR.components(df, "a", "b").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_canonical_merge(spark, seed):
    r = random.Random(seed)
    n = 40
    level = [r.randrange(5) for _ in range(n)]
    # A clique of copies besides random pairs.
    pairs = sorted({(a, b) for a in range(14) for b in range(a + 1, 14)} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(60)})
    canon = {}
    for a, b in pairs:
        if a in canon or b in canon:
            continue
        win, lose = (a, b) if level[a] >= level[b] else (b, a)
        canon[lose] = win
    events = spark.createDataFrame([(f"e{i:02d}", float(level[i])) for i in range(n)], "id string, significance double")
    verified = spark.createDataFrame([(f"e{a:02d}", f"e{b:02d}", i) for i, (a, b) in enumerate(pairs)], "a string, b string, ord int")
    got = {x["id"]: x["canonical_id"] for x in GR.canonical_merge(events, verified).collect() if x["canonical_id"]}
    assert got == {f"e{k:02d}": f"e{w:02d}" for k, w in canon.items()}


@pytest.mark.parametrize(("seed", "range_rows"), [(0, 1000), (1, 1000), (2, 20), (3, 5)])
def test_pin_clusters(spark, seed, range_rows):
    r = random.Random(seed)
    pins = []
    for i in range(150):
        x, y = (50.0, 50.0) if i % 3 == 0 else (r.uniform(-60, 300), r.uniform(-60, 300))
        pins.append((f"p{i:03d}", i, x, y, x, y))
    cells, want = {}, {}
    for name, _, x, y, *_ in pins:
        # Cells are searched column by column, leaders of a cell in the order they came.
        cx, cy = math.floor(x / 28), math.floor(y / 28)
        near = [q for i in (-1, 0, 1) for j in (-1, 0, 1) for q in cells.get((cx + i, cy + j), []) if math.hypot(q[1] - x, q[2] - y) <= 28]
        if near:
            want[name] = near[0][0]
        else:
            cells.setdefault((cx, cy), []).append((name, x, y))
            want[name] = name
    df = spark.createDataFrame(pins, "id string, prio int, x double, y double, lat double, lng double")
    assert {x["id"]: x["leader"] for x in GR.pin_clusters(df, 28.0, range_rows).collect()} == want


@pytest.fixture
def rounds(monkeypatch):
    """Number of rounds of the selections run so far."""
    seen = []
    whole = GR.in_ranges
    monkeypatch.setattr(GR, "in_ranges", lambda *a: (seen.append(1), whole(*a))[1])
    return seen


@pytest.mark.parametrize("range_rows", [GR.RANGE_ROWS, 500])
def test_chains_settle_in_few_rounds(spark, rounds, range_rows):
    n = 2000
    claims = spark.range(n).select("id", F.col("id").alias("prio"), F.explode(F.array("id", F.col("id") + 1)).alias("key"))
    assert {r["id"] for r in GR.first_kept(claims, range_rows).collect()} == set(range(1, n, 2))
    assert len(rounds) < 15
    rounds.clear()
    pins = spark.range(n).select("id", F.col("id").alias("prio"), (F.col("id") * 20.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 20.0).alias("lat"), F.lit(0.0).alias("lng"))
    got = {r["id"]: r["leader"] for r in GR.pin_clusters(pins, 28.0, range_rows).collect()}
    assert set(got.values()) == set(range(0, n, 2)) and len(rounds) < 15
    rounds.clear()
    events = spark.range(n).select(F.col("id"), (-F.col("id")).cast("double").alias("significance"))
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (n - F.col("id")).alias("ord"))
    merged = {r["id"]: r["canonical_id"] for r in GR.canonical_merge(events, pairs, range_rows).collect() if r["canonical_id"] is not None}
    canon = {}
    for a in range(n - 2, -1, -1):
        if a not in canon and a + 1 not in canon:
            canon[a + 1] = a
    assert merged == canon and len(rounds) < 15


@pytest.mark.parametrize("seed", range(3))
def test_selections_cut_into_many_ranges(spark, rounds, seed):
    r = random.Random(seed)
    rows = [(i, i, r.randrange(60)) for i in range(150) for _ in range(r.randrange(1, 4))]
    seen, dropped = set(), set()
    for i in range(150):
        keys = {k for a, _, k in rows if a == i}
        if keys & seen:
            dropped.add(i)
        else:
            seen |= keys
    df = spark.createDataFrame(rows, "id int, prio int, key int")
    assert {x["id"] for x in GR.first_kept(df, 17).collect()} == dropped
    assert len(rounds) > 1
    pairs = [(r.randrange(40), r.randrange(40), i) for i in range(150)]
    pairs = [p for p in pairs if p[0] != p[1]]
    level, canon = [r.randrange(6) for _ in range(40)], {}
    for a, b, _ in pairs:
        if a not in canon and b not in canon:
            win, lose = (a, b) if level[a] >= level[b] else (b, a)
            canon[lose] = win
    events = spark.createDataFrame([(i, float(level[i])) for i in range(40)], "id int, significance double")
    got = GR.canonical_merge(events, spark.createDataFrame(pairs, "a int, b int, ord int"), 13)
    assert {x["id"]: x["canonical_id"] for x in got.collect() if x["canonical_id"] is not None} == canon


def test_pin_cluster_examples(spark):
    def clusters(*pins):
        df = spark.createDataFrame([(n, i, float(x), float(y), float(lat), float(lng)) for i, (n, x, y, lat, lng) in enumerate(pins)], "id string, prio int, x double, y double, lat double, lng double")
        out = {}
        for row in GR.pin_clusters(df, 28.0).orderBy("prio").collect():
            out.setdefault(row["leader"], ([], row["colocated"]))[0].append(row["id"])
        return out

    assert {k: v[0] for k, v in clusters(("a", 100, 100, 100, 100), ("b", 120, 100, 120, 100), ("c", 300, 300, 300, 300), ("d", 127, 100, 127, 100)).items()} == {"a": ["a", "b", "d"], "c": ["c"]}
    assert {k: v[0] for k, v in clusters(("a", 0, 0, 0, 0), ("b", 25, 0, 25, 0), ("c", 50, 0, 50, 0)).items()} == {"a": ["a", "b"], "c": ["c"]}
    assert clusters(("a", 10, 10, 5, 5), ("b", 10, 10, 5, 5), ("c", 12, 10, 6, 5)) == {"a": (["a", "b", "c"], False)}
    assert clusters(("a", 10, 10, 5, 5), ("b", 10, 10, 5, 5)) == {"a": (["a", "b"], True)}


@pytest.mark.parametrize("spread, batch", [(30.0, 7), (5.0, 3), (0.0, 4)])
def test_pin_spread(spark, spread, batch):
    r = random.Random(9)
    rows = [(f"e{i:03d}", 10.0 if i % 3 == 0 else r.uniform(-80, 80), 20.0 if i % 3 == 0 else r.uniform(-180, 180), round(r.random(), 3)) for i in range(120)]
    vec = lambda p: [math.cos(math.radians(p[1])) * math.cos(math.radians(p[2])), math.cos(math.radians(p[1])) * math.sin(math.radians(p[2])), math.sin(math.radians(p[1]))]
    angle = lambda p, q: math.degrees(math.acos(max(-1, min(1, sum(a * b for a, b in zip(vec(p), vec(q)))))))
    want = []
    for row in sorted(rows, key=lambda x: (-x[3], x[0])):
        if len(want) < 12 and not any(angle(row, p) < spread for p in want):
            want.append(row)
    df = spark.createDataFrame(rows, "id string, lat double, lng double, score double")
    assert [x["id"] for x in GR.pin_spread(df, 12, spread, batch).orderBy("pick").collect()] == [w[0] for w in want]


@pytest.mark.parametrize("seed", range(3))
def test_top_feed(spark, seed):
    r = random.Random(seed)
    rows, roots = [], {f"e{i:03d}": f"e{i // 4 * 4:03d}" for i in range(200) if i % 5 < 3}
    for user in range(3):
        for i in range(200):
            rows.append((user, f"e{i:03d}", r.choice(LAYERS + ["unknown"]) if user else "news", round(r.random(), 2)))
    want = {}
    for user in range(3):
        feed, stories, used = [], set(), {}
        for _, i, layer, score in sorted((x for x in rows if x[0] == user), key=lambda x: (-x[3], x[1])):
            story, cat = roots.get(i, i), LAYER_CATEGORY.get(layer, "other")
            if story in stories or used.get(cat, 0) >= 4:
                continue
            stories.add(story)
            used[cat] = used.get(cat, 0) + 1
            feed.append(i)
            if len(feed) == 20:
                break
        want[user] = feed
    scored = spark.createDataFrame(rows, "user_id int, id string, layer_id string, score double")
    stories = spark.createDataFrame(list(roots.items()), "id string, root string")
    got = {}
    for x in PE.top_feed(scored, stories).orderBy("user_id", "rank").collect():
        got.setdefault(x["user_id"], []).append(x["id"])
    assert got == want


def test_nearest_vectors_across_blocks(spark):
    r = random.Random(6)
    rows = [(f"v{i:03d}", [r.gauss(0, 1) for _ in range(4)], "hot" if i % 3 else "cold") for i in range(120)]
    q, items = rows[:40], rows[40:]
    kind = "id string, vector array<double>, label string"
    want = {}
    for a in q:
        ranked = sorted(((-sum(x * y for x, y in zip(a[1], b[1])), b[0]) for b in items if b[2] == a[2]))[:5]
        want[a[0]] = {i for _, i in ranked}
    got = {}
    for x in PA.nearest_vectors(spark.createDataFrame(q, kind), spark.createDataFrame(items, kind), 5, block=8).collect():
        got.setdefault(x["id"], set()).add(x["item_id"])
    assert got == want


def test_topic_windows(spark):
    r = random.Random(2)
    rows = [(f"n{i:03d}", "hot" if i % 3 == 0 else r.choice("ab"), r.randrange(0, 9) * DAY // 2) for i in range(120)]
    want = {}
    for a in rows:
        want[a[0]] = sum(b[1] == a[1] and b[0] != a[0] and b[2] > a[2] - 3 * DAY and (b[2] < a[2] or (b[2] == a[2] and a[0] < b[0])) for b in rows)
    got = {x["id"]: x["n"] for x in PA.topic_windows(spark.createDataFrame(rows, "id string, category string, t_us bigint")).collect()}
    assert got == want
