"""Capped, fair and paged selections.

Each per-group pick is a ``row_number() <= k`` filter, which Spark also applies before the shuffle
(WindowGroupLimit), so a group holding a large share of the rows sends k rows per task, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import layer_category
from ..session import cut

MAX_MARKERS = 5000
# Spark pushes row_number() <= k below the shuffle for k under this limit (windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SLICES = 64
COUNTRY_CAP = 30
PUBLISHERS_PER_COUNTRY = 10
MAX_SOURCE_CLICKS = 3
MAX_INTERACTIONS = 500


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group with their rank. ``order`` must be total within a group."""
    number = lambda part: F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    if k >= GROUP_LIMIT:
        # Too large for Spark's own limit before the shuffle: cut every slice of a group first, then the group.
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]), F.lit(SLICES)))
        df = sliced.withColumn("_cut", number([*keys, "_slice"])).filter(F.col("_cut") <= k).drop("_slice", "_cut")
    return df.withColumn(rank, number(keys)).filter(F.col(rank) <= k)


def by_significance() -> list[Column]:
    return [F.desc("significance"), F.asc("id")]


def fair_pick(items: DataFrame, cap: int = COUNTRY_CAP) -> DataFrame:
    """Up to ``cap`` items per country, dealt in turns over its publishers: newest first, undated last.

    Turn t of the deal holds the t-th item of every publisher, freshest publisher first, so the deal is the order
    (turn, freshness of the publisher) and the cap is its first rows.
    """
    newest = [F.desc_nulls_last("published_at"), F.asc("item_id")]
    turns = first_k(items, ["country", "publisher_id"], newest, cap, "turn")
    fresh = Window.partitionBy("country", "publisher_id")
    turns = turns.withColumn("freshest", F.max("published_at").over(fresh))
    return first_k(turns, ["country"], [F.asc("turn"), F.desc_nulls_last("freshest"), F.asc("publisher_id")], cap, "pick")


def headline_feed(events: DataFrame, count: int, per_category: int) -> DataFrame:
    """The most significant events, at most ``per_category`` of a category while others have some; then refilled."""
    ranked = first_k(events.withColumn("category", layer_category(F.col("layer_id"))), ["category"], by_significance(), count, "in_category")
    within_cap = F.col("category").isNotNull() & (F.col("in_category") <= per_category)
    chosen = ranked.orderBy(F.when(within_cap, 0).otherwise(1), *by_significance()).limit(count)
    return chosen.orderBy(*by_significance())


def rank_among(events: DataFrame, headlines: DataFrame) -> DataFrame:
    """1-based rank of each event among the headlines, 0 if it is none. Headlines are a bounded list (their count)."""
    ranked = headlines.select("id", F.row_number().over(Window.orderBy(*by_significance())).alias("rank"))
    return events.join(ranked, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def marker_cap(events: DataFrame, limit: int = MAX_MARKERS) -> DataFrame:
    return events.orderBy(*by_significance()).limit(limit)


def tour_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("lat"), F.asc("lng"), F.asc("id"))


def canonical_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("occurred_at"), F.asc("id"))


def click_cap(actions: DataFrame) -> DataFrame:
    """Per user and event: the three newest article clicks and the newest open."""
    newest = [F.desc("acted_at"), F.desc("seq")]
    ranked = first_k(actions.filter(F.col("kind").isin("source", "open")), ["user_id", "event_id", "kind"], newest, MAX_SOURCE_CLICKS)
    return ranked.filter((F.col("kind") == "source") | (F.col("rn") == 1))


def last_interactions(actions: DataFrame, key: str, order: list[Column], k: int = MAX_INTERACTIONS) -> DataFrame:
    return first_k(actions, [key], order, k)


def saved_since(actions: DataFrame) -> DataFrame:
    """Items still saved, with the time of the first save after the last removal."""
    keys = ["user_id", "event_id"]
    removed = actions.filter("kind = 'unsave'").groupBy(*keys).agg(F.max("seq").alias("removed"))
    saves = actions.filter("kind = 'save'").join(removed, keys, "left")
    live = saves.filter(F.col("removed").isNull() | (F.col("seq") > F.col("removed")))
    return live.groupBy(*keys).agg(F.min("acted_at").alias("added_at"), F.min_by("view", "seq").alias("view"))


def latest_feedback(actions: DataFrame) -> DataFrame:
    """The last opinion per user and event; a cleared one is gone."""
    last = actions.filter(F.col("kind").isin("more", "less", "clear")).groupBy("user_id", "event_id").agg(
        F.max_by(F.struct("kind", "acted_at", "view"), "seq").alias("last"))
    return last.select("user_id", "event_id", "last.*").filter("kind <> 'clear'")


def publisher_cap(candidates: DataFrame, limit: int = PUBLISHERS_PER_COUNTRY) -> DataFrame:
    """Up to ``limit`` publishers per country, most items first; a domain serves the first country (in order) that takes it.

    Input: country_pos, domain, items. Taking countries in turn gives the same result as rounds of offers: every
    country offers for its best domains that have not turned it down, and each domain keeps the earliest country.
    All domains agree on which country comes first, so the stable outcome is unique and equals the sequential one.
    """
    best = candidates.filter(F.coalesce("domain", F.lit("")) != "").groupBy("country_pos", "domain").agg(F.max("items").alias("items"))
    open_offers = cut(best)
    # Every round takes at least one offer away, so rounds need no limit.
    while True:
        offers = cut(first_k(open_offers, ["country_pos"], [F.desc("items"), F.asc("domain")], limit))
        kept = offers.groupBy("domain").agg(F.min("country_pos").alias("keeper"))
        refused = offers.join(kept, "domain").filter(F.col("country_pos") != F.col("keeper")).select("country_pos", "domain")
        if refused.isEmpty():
            return offers
        open_offers = cut(open_offers.join(refused, ["country_pos", "domain"], "left_anti"))


def top_terms(terms: Column, k: int = 3) -> Column:
    """Texts of the k strongest terms: by confidence, then by text."""
    keyed = F.transform(terms, lambda t: F.struct((-F.coalesce(t["relevance"], t["confidence"], F.lit(0.0))).alias("neg"), t["text"].alias("text")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda t: t["text"])

