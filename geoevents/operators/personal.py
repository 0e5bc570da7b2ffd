"""Personal feeds: signals, taste vectors, interest matches and the ranked feed, for all users at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as Y
from ..functions import geo as G
from ..functions import score as M
from ..functions import text as X
from ..functions import times as C
from ..schema import CATEGORIES, layer_category
from .ranking import click_cap, first_k, last_interactions, latest_feedback, saved_since
from .requests import asked_key, sieved
from .shortlists import PER_CATEGORY
from .vectors import weighted_sum

# Signal weights, thresholds and feed weights.
SEED_WEIGHT = 1.0
SIGNAL_WEIGHTS = {"more": 2.0, "save": 1.5, "source": 1.0, "open": 0.3}
LESS_WEIGHT = 2.0
VIEW_MULTIPLIER = {"feed": 1.5, "explore": 1.0, "headlines": 0.7}
SIMILAR_REASON = 0.55
LIKED_LIMIT = 30
RERANK_POOL, RERANK_THRESHOLD = 20, 0.2


# ---------------------------------------------------------------- signals

def view_multiplier(view: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in VIEW_MULTIPLIER.items():
        out = F.when(view == name, factor).otherwise(out)
    return out


def signal_weights(actions: DataFrame, as_of: Column) -> DataFrame:
    """Positive and negative weight per user and event. "Less" cancels every positive signal of its event.

    Input: user_id, event_id, kind (save, unsave, more, less, clear, source, open), view, acted_at, seq.
    """
    keys = ["user_id", "event_id"]
    weigh = lambda base, at: F.lit(base) * view_multiplier(F.col("view")) * C.half_life_decay(at, as_of)
    saved = saved_since(actions).select(*keys, weigh(SIGNAL_WEIGHTS["save"], F.col("added_at")).alias("w"))
    feedback = latest_feedback(actions)
    liked = feedback.filter("kind = 'more'").select(*keys, weigh(SIGNAL_WEIGHTS["more"], F.col("acted_at")).alias("w"))
    less = feedback.filter("kind = 'less'").select(*keys, weigh(LESS_WEIGHT, F.col("acted_at")).alias("negative"))
    interactions = last_interactions(actions.filter(F.col("kind").isin("source", "open")), "user_id", [F.desc("acted_at"), F.desc("seq")])
    clicks = click_cap(interactions.drop("rn"))
    base = F.when(F.col("kind") == "source", SIGNAL_WEIGHTS["source"]).otherwise(SIGNAL_WEIGHTS["open"])
    clicked = clicks.select(*keys, (base * view_multiplier(F.col("view")) * C.half_life_decay(F.col("acted_at"), as_of)).alias("w"))
    positive = saved.unionByName(liked).unionByName(clicked).groupBy(*keys).agg(F.sum("w").alias("positive"))
    return positive.join(less, keys, "full").select(*keys, F.when(F.col("negative").isNull(), F.col("positive")).alias("positive"), "negative")


# ---------------------------------------------------------------- vectors

def unit_mean(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Direction of the mean vector per key; keys whose mean is zero have none."""
    return weighted_sum(rows, keys, vector).withColumn("vector", Y.unit(F.col("vector"))).filter("vector is not null")


def centered(vectors: DataFrame, sample: DataFrame) -> DataFrame:
    """Vectors minus the mean of the sample's vectors, at unit length. Keeps sample members and interest seeds. Input: key, vector.

    Where no vector belongs to the sample there is no mean, and all vectors come back as they are.
    """
    marked = vectors.join(sample.select("key").distinct().withColumn("_member", F.lit(True)), "key", "left")
    # The last element counts the members.
    sums = weighted_sum(marked.filter("_member").select(F.concat("vector", F.array(F.lit(1.0))).alias("v")), [], "v")
    mean = sums.select(F.transform(F.slice("vector", 1, F.size("vector") - 1), lambda x: x / F.element_at("vector", -1)).alias("mean")).scalar()
    shifted = marked.withColumn("_mean", mean)
    kept = shifted.filter(F.col("_mean").isNull() | F.col("_member") | F.startswith("key", F.lit("interest:")))
    moved = F.when(F.col("_mean").isNull(), F.transform("vector", lambda x: x.cast("double"))).otherwise(Y.unit(Y.minus(F.col("vector"), F.col("_mean"))))
    return kept.select("key", moved.alias("vector")).filter("vector is not null")


def interest_keys(spark: SparkSession, catalogue: list[tuple]) -> DataFrame:
    """What makes an event match an interest: (kind, key, interest_id, label, position, score), a few hundred rows at most."""
    rows = []
    for position, (name, _group, label, layers, keywords, box) in enumerate(catalogue):
        keys = [("word", k, 1.0) for k in keywords] + [("layer", k, 0.6) for k in layers] + ([("place", name, 0.6)] if box else [])
        rows += [(kind, key, name, label, position, score) for kind, key, score in keys]
    return spark.createDataFrame(rows, "kind string, key string, interest_id string, label string, position int, score double")


def event_interests(events: DataFrame, catalogue: list[tuple], terms: Column | None = None) -> DataFrame:
    """One row per event and matching interest (id, interest_id, label, position, score): whole words 1, layer or region 0.6.

    An event lists its keys (the catalogue's words and word sequences it says, its layer, the regions it lies in),
    and the keys meet the catalogue, a constant that fits into every task.
    """
    text = F.col("title") if terms is None else F.concat_ws(" ", F.col("title"), F.array_join(terms, " "))
    key = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    known = frozenset(k for row in catalogue for k in row[4])
    lengths = sorted({len(k.split()) for k in known})

    def said(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            found = [{run for n in lengths for i in range(len(words) - n + 1) if (run := words[i] if n == 1 else " ".join(words[i : i + n])) in known} if words else set() for words in array.to_pylist()]
            yield pa.array([sorted(f) for f in found], pa.list_(pa.string()))

    said.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    boxes = [F.when(F.col("lat").between(south, north) & F.col("lng").between(west, east), key("place")(F.lit(row[0])))
             for row in catalogue if row[5] for south, north, west, east in [row[5]]]
    worded = events.withColumn("_said", F.arrow_udf(said, "array<string>")(X.word_list(text)))
    keys = F.concat(F.transform("_said", key("word")), F.array(key("layer")(F.col("layer_id"))), F.array_compact(F.array(*boxes)) if boxes else F.array())
    listed = worded.select("id", F.inline(keys))
    met = listed.join(F.broadcast(interest_keys(events.sparkSession, catalogue)), ["kind", "key"])
    return met.groupBy("id", "interest_id", "label", "position").agg(F.max("score").alias("score"))


def seed_fallback(seeds: DataFrame, matches: DataFrame, vectors: DataFrame) -> DataFrame:
    """Real seeds, and for interests without one the direction of the events that match it. Input: seeds (interest_id, vector)."""
    missing = matches.join(seeds.select("interest_id"), "interest_id", "left_anti")
    rows = missing.select("interest_id", F.col("id").alias("key")).join(vectors, "key")
    return seeds.select("interest_id", "vector").unionByName(unit_mean(rows, ["interest_id"]))


def taste_vectors(interests: DataFrame, seeds: DataFrame, signals: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user: taste (what they follow and like) and avoid (what they want less of), each at unit length or null."""
    followed = interests.join(seeds, "interest_id").select("user_id", "vector", F.lit(SEED_WEIGHT).alias("w"))
    known = signals.join(vectors.withColumnRenamed("key", "event_id"), "event_id")
    liked = known.filter("positive is not null").select("user_id", "vector", F.col("positive").alias("w"))
    avoided = known.filter("negative is not null").select("user_id", "vector", F.col("negative").alias("w"))
    direction = lambda rows, name: weighted_sum(rows, ["user_id"], "vector", F.col("w")).select("user_id", Y.unit(F.col("vector")).alias(name))
    return direction(followed.unionByName(liked), "taste").join(direction(avoided, "avoid"), "user_id", "full")


# ---------------------------------------------------------------- the feed

def top_feed(scored: DataFrame, stories: DataFrame, n: int = 20) -> DataFrame:
    """The best n per user with one event per story and at most four per category, taken by score.

    Two exact cuts come first. Of a story in a category only its best event can be taken. And of a category only its first 4·C
    can matter (C categories), as stories taken in other categories can block at most 4·(C−1) of them. So at
    most 28·7 rows per user reach the walk, however many events were scored.
    """
    order = [F.desc("score"), F.asc("id")]
    categories = len(CATEGORIES) + 1
    placed = scored.join(stories.select("id", "root"), "id", "left").withColumn("story", F.coalesce("root", "id")).withColumn("category", layer_category(F.col("layer_id"), "other"))
    keys = ["user_id", "story", "category"]
    # Most events are a story of their own and need no grouping.
    grouped = placed.filter("root is not null").groupBy(*keys).agg(F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("neg"), "id")).alias("e"))
    columns = [*keys, "id", "score"]
    best = placed.filter("root is null").select(*columns).unionByName(grouped.select(*keys, "e.*"))
    short = first_k(best, ["user_id", "category"], order, PER_CATEGORY * categories)
    kind = dict(scored.dtypes)["user_id"]
    names = ["user_id", "id", "category", "score", "story"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, seen, used, taken, schema = object(), set(), {}, 0, None
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in names[:4]]).append(pa.field("rank", pa.int32()))
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] != user:
                    user, seen, used, taken = row[0], set(), {}, 0
                if taken == n or row[4] in seen or used.get(row[2], 0) >= PER_CATEGORY:
                    continue
                seen.add(row[4])
                used[row[2]] = used.get(row[2], 0) + 1
                taken += 1
                out.append((*row[:4], taken))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    # A user's rows stream through one task in order.
    stream = short.select(*names).repartition("user_id").sortWithinPartitions("user_id", *order)
    return stream.mapInArrow(walk, f"user_id {kind}, id string, category string, score double, rank int")


def liked_reason(feed: DataFrame, signals: DataFrame, vectors: DataFrame, titles: DataFrame, at_least: float = SIMILAR_REASON) -> DataFrame:
    """Per feed row the liked event it is most like, if near enough: user_id, id, liked_id, closeness, reason. Thirty strongest likes count.

    A user's feed and likes are short lists, so each user is one row with both, and only the nearest like leaves the task.
    """
    have = signals.filter("positive is not null").join(vectors.select(F.col("key").alias("event_id"), "vector"), "event_id")
    liked = first_k(have, ["user_id"], [F.desc("positive"), F.asc("event_id")], LIKED_LIMIT)
    shown = feed.select("user_id", "id").join(vectors.select(F.col("key").alias("id"), "vector"), "id")
    listed = lambda rows, key, name: rows.groupBy("user_id").agg(F.collect_list(F.struct(F.col(key).alias("id"), "vector")).alias(name))
    both = listed(shown, "id", "shown").join(listed(liked, "event_id", "liked"), "user_id")
    kind = dict(feed.dtypes)["user_id"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for user, mine, likes in zip(*(batch.column(c).to_pylist() for c in ("user_id", "shown", "liked"))):
                likes.sort(key=lambda x: x["id"])
                # Element by element, so equal vectors are equally close.
                products = np.array([x["vector"] for x in mine])[:, None, :] * np.array([x["vector"] for x in likes])[None, :, :]
                closeness = products.sum(axis=2)
                for x, row in zip(mine, closeness):
                    # The last of the nearest, as likes are in order of their ids.
                    other = [(c, y["id"]) for c, y in zip(row.tolist(), likes) if y["id"] != x["id"]]
                    if other:
                        out.append((user, x["id"], *max(other)))
            schema = pa.schema([batch.schema.field("user_id"), ("id", pa.string()), ("closeness", pa.float64()), ("liked_id", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    best = both.mapInArrow(nearest, f"user_id {kind}, id string, closeness double, liked_id string")
    named = best.filter(F.col("closeness") >= at_least).join(titles.select(F.col("id").alias("liked_id"), "title"), "liked_id").filter("title <> ''")
    short = F.concat(F.substring("title", 1, 60), F.when(F.char_length("title") > 60, F.lit("…")).otherwise(F.lit("")))
    return named.select("user_id", "id", "liked_id", "closeness", F.concat(F.lit("Like “"), short, F.lit("”")).alias("reason"))


def with_reasons(feed: DataFrame, matches: DataFrame, interests: DataFrame, liked: DataFrame) -> DataFrame:
    """Why each feed row is there: up to two followed interests, a liked event, else closeness alone."""
    keys = ["user_id", "id"]
    followed = feed.select(*keys).join(matches, "id").join(interests, ["user_id", "interest_id"])
    # At most one row per interest of the catalogue.
    ranked = followed.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "position", "label"))), 1, 2).alias("top"))
    labels = ranked.select(*keys, F.transform("top", lambda t: F.concat(F.lit("You follow "), t["label"])).alias("labels"))
    joined = feed.join(labels, keys, "left").join(liked.select(*keys, "reason"), keys, "left")
    reasons = F.array_compact(F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.array("reason")))
    return joined.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Close to what you read")))).drop("labels", "reason")


def reading_list(saved: DataFrame, events: DataFrame) -> DataFrame:
    """Saved items that still exist, most recently saved first."""
    return saved.join(events.select(F.col("id").alias("event_id"), "title"), "event_id").orderBy("user_id", F.desc("added_at"), "event_id")


# ---------------------------------------------------------------- request-based feed

def keyword_feed(configs: DataFrame, events: DataFrame, as_of: Column, n: int = 20, stage1: int | None = None, days: int = 7) -> DataFrame:
    """Events ranked for each request config. configs: user_id, layers, keywords, coordinates, floor; events: id, title, terms, …

    Configs that ask for the same are answered once. They meet events on the layer, block by block (see ``requests``); floor and week are filters. With ``stage1`` only the newest
    so many of a user's are scored (a cost rule), by default all of them.
    """
    asks = ["layers", "keywords", "coordinates", "floor"]
    asking = configs.select("user_id", *asks, asked_key(asks).alias("asked"))
    different = asking.groupBy("asked").agg(*[F.first(c).alias(c) for c in asks])
    # Words are prepared once per event and once per config, before they meet.
    wanted = different.withColumn("layer_id", F.explode(F.array_distinct("layers"))).withColumn("keywords", X.prepared_keywords(F.col("keywords"))).drop("layers")
    recency = C.recency_score(F.col("occurred_at"), as_of)
    recent = events.filter(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).withColumn("tokens", X.search_words(F.col("title"), F.col("terms"))).select(
        "id", "layer_id", "lat", "lng", "significance", "occurred_at", "tokens", F.array_join("tokens", " ").alias("full"))
    if stage1 is None:
        base = M.W_SIGNIFICANCE * M.significance_norm(F.col("significance")) + M.W_RECENCY * recency
        pool = sieved(wanted, recent.filter("layer_id is not null and significance is not null").withColumn("base", base), n)
    else:
        met = recent.join(wanted, "layer_id").filter(F.col("significance") >= F.col("floor"))
        pool = first_k(met, ["asked"], [F.desc("occurred_at"), F.asc("id")], stage1, "newest")
    distance = F.array_min(F.transform("coordinates", lambda p: G.haversine_km(F.col("lat"), F.col("lng"), p["lat"], p["lng"])))
    keyword = X.keyword_hits(F.col("tokens"), F.col("full"), F.col("keywords"))
    scored = pool.withColumn("keyword", keyword).withColumn("score", F.round(
        M.composite_score(M.coord_score(distance), F.col("keyword"), F.col("significance"), recency), 6)).select("asked", "id", "score", "keyword")
    best = first_k(scored, ["asked"], [F.desc("score"), F.asc("id")], n, "rank")
    return asking.select("user_id", "asked").join(best, "asked").select("user_id", "id", "score", "keyword", "rank")


def rerank_trigger(feed: DataFrame) -> DataFrame:
    """Users whose best candidates hardly match their keywords."""
    pool = feed.filter(F.col("rank") <= RERANK_POOL)
    return pool.groupBy("user_id").agg((F.max("keyword") < RERANK_THRESHOLD).alias("rerank"))


def rerank_merge(feed: DataFrame, reranked: DataFrame) -> DataFrame:
    """Feed with the given order first (only ids of the pool count), then the rest of the pool, then later ranks."""
    pool_order = F.when(F.col("rank") <= RERANK_POOL, F.col("new_rank"))
    joined = feed.join(reranked.select("user_id", "id", F.col("rank").alias("new_rank")), ["user_id", "id"], "left")
    order = [F.asc_nulls_last("_new"), F.asc("rank")]
    # One row per event a user was shown: the feed is ranked per user already.
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return joined.withColumn("_new", pool_order).withColumn("place", place).drop("_new", "new_rank")
