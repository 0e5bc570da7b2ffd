"""Filters, predicates and work lists over events, feeds and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as C
from ..schema import LAYERS, layer_category

MAX_FEED_ERRORS = 5
FEED_LIMIT = 5000
IMAGE_SOURCES = ["gnews", "wikifeeds", "conflict_csv", "usgs", "gdacs"]


def event_filter(events: DataFrame, layers: list[str] | None = None, min_significance: float = 0.0,
                 start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Layer in set (none given: all), significance floor, start inclusive, end exclusive."""
    keep = F.col("significance") >= min_significance
    if layers:
        keep &= F.col("layer_id").isin(layers)
    if start is not None:
        keep &= F.col("occurred_at") >= start
    if end is not None:
        keep &= F.col("occurred_at") < end
    return events.filter(keep)


def feed_stage1(events: DataFrame, layers: list[str], floor: float, as_of: Column, days: int = 7, limit: int = FEED_LIMIT) -> DataFrame:
    """The newest events of the chosen layers in the last week. No layers means no events."""
    recent = events.filter(F.col("layer_id").isin(layers) & (F.col("significance") >= floor)
                           & (F.col("occurred_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    return recent.orderBy(F.desc("occurred_at"), "id").limit(limit)


def feed_candidates(events: DataFrame) -> DataFrame:
    """Stories a personal feed may hold: no fire clusters and no natural-hazard layers; unknown layers stay."""
    return events.filter((F.col("source") != "firms") & ~layer_category(F.col("layer_id")).eqNullSafe(F.lit("hazards")))


def due_feeds(feeds: DataFrame, publishers: DataFrame, as_of: Column, countries: list[str] | None = None) -> DataFrame:
    """Healthy feeds of approved publishers whose polling time has come."""
    approved = publishers.filter(F.col("status") == "approved")
    if countries:
        approved = approved.filter(F.col("country").isin(countries))
    waited = C.micros(as_of) - C.micros(F.col("last_fetched_at"))
    due = F.col("last_fetched_at").isNull() | (waited >= F.col("poll_minutes") * F.lit(60_000_000))
    return feeds.filter((F.col("error_count") < MAX_FEED_ERRORS) & due).join(approved.select("publisher_id", "country"), "publisher_id")


def window_verdict(published: Column, as_of: Column, hours: int = 48, ahead_hours: int = 2) -> Column:
    """Whether an item's time is acceptable; unknown times are."""
    inside = (published >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (published <= as_of + F.expr(f"INTERVAL {ahead_hours} HOURS"))
    return published.isNull() | inside


def junk_reason(title: Column, url: Column) -> Column:
    """Why an item is obviously no news; null if it may be."""
    return (F.when(F.rlike(title, F.lit(X.JUNK_TITLE)), F.lit("junk title"))
            .when(F.rlike(X.url_path(url), F.lit(X.JUNK_PATH)), F.lit("junk path")))


def news_with_keywords(events: DataFrame) -> DataFrame:
    return events.filter(F.col("source").isin("gnews", "wikifeeds") & (F.size("keywords") > 0))


def missing_images(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events to look for an image for, most significant first within each source."""
    work = events.filter(F.col("source").isin(IMAGE_SOURCES) & F.col("image_url").isNull()).orderBy("source", F.desc("significance"), "id")
    return work if limit is None else work.limit(limit)


def coordinate_tally(events: DataFrame, key: str) -> DataFrame:
    """Rows with and without coordinates per key."""
    usable = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return events.groupBy(key).agg(F.count_if(usable).alias("kept"), F.count_if(~usable).alias("skipped"))


def link_filter(links: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Confident links; unknown relations read as co-occurrence."""
    relation = F.when(F.col("relation").isin(X.ALLOWED_RELATIONS), F.col("relation")).otherwise(F.lit("co_occurs"))
    return links.filter(F.col("confidence") >= min_confidence).withColumn("relation", relation)


def web_citations(citations: Column) -> Column:
    return F.filter(citations, lambda c: F.startswith(c, F.lit("http")))


def restrict_ids(markers: DataFrame, allowed: DataFrame) -> DataFrame:
    return markers.join(allowed.select("id"), "id", "left_semi")


def links_touching(links: DataFrame, event_id: str) -> DataFrame:
    """Links at either end; two equality filters, each of which can be pushed down."""
    at_source = links.filter(F.col("source_id") == event_id)
    at_target = links.filter((F.col("target_id") == event_id) & (F.col("source_id") != event_id))
    return at_source.unionByName(at_target)


def viewport_top(points: DataFrame, recent: DataFrame, group: str, width: float, height: float, inset: float = 0.2) -> DataFrame:
    """Most significant front-facing point per view, inside its central box and not shown recently."""
    x, y = F.col("x"), F.col("y")
    inside = (F.col("front") & (x > width * inset) & (x < width * (1 - inset)) & (y > height * inset) & (y < height * (1 - inset)))
    fresh = points.filter(inside).join(recent.select("id"), "id", "left_anti")
    # Highest significance, then lowest id: min of (-significance, id) combines map-side.
    best = fresh.groupBy(group).agg(F.min(F.struct((-F.col("significance")).alias("neg"), F.col("id").alias("id"))).alias("best"))
    return best.select(group, F.col("best.id").alias("id"), (-F.col("best.neg")).alias("significance"))


def config_violation(lat: Column, lng: Column, keywords: Column, layers: Column, start: Column, end: Column, significance: Column) -> Column:
    """First rule a request breaks; null if it is valid."""
    bad_keyword = F.exists(keywords, lambda k: (F.char_length(F.trim(k)) < 1) | (F.char_length(k) > 100))
    unknown = F.exists(layers, lambda layer: ~layer.isin(LAYERS))
    return (F.when(lat.isNull() != lng.isNull(), F.lit("lat and lng must be supplied together"))
            .when((F.abs(lat) > 90) | (F.abs(lng) > 180), F.lit("coordinates out of range"))
            .when(~significance.between(0, 100), F.lit("significance out of range"))
            .when(F.size(keywords) > 20, F.lit("too many keywords"))
            .when(bad_keyword, F.lit("keyword length")).when(unknown, F.lit("unknown layer"))
            .when(start > end, F.lit("start after end")))


def active_events(events: DataFrame) -> DataFrame:
    """Rows that are no duplicate of another and not archived."""
    keep = F.col("canonical_id").isNull()
    if "archived_at" in events.columns:
        keep &= F.col("archived_at").isNull()
    return events.filter(keep)


def pending_vectors(seeds: DataFrame, events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys still without a vector, interest seeds before events."""
    wanted = seeds.select("key", F.lit(0).alias("priority")).unionByName(events.select("key", F.lit(1).alias("priority")))
    return wanted.join(vectors.select("key"), "key", "left_anti").orderBy("priority", "key")


def known_interests(profile: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Chosen interests that the catalogue still offers."""
    return profile.join(catalogue.select("interest_id"), "interest_id", "left_semi")
