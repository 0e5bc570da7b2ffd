"""Table maintenance by rewriting: upserts, status changes, retention, versioned snapshots.

Each operator takes the stored rows and the new ones and returns the rows of the next version. Latest-per-key is an
aggregation (``max_by``), so a key repeated very often in the input is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LAYERS
from .dedup import last_wins
from .filters import MAX_FEED_ERRORS
from .links import DEFAULT_LOCAL_SIGNIFICANCE, locality
from .tables import current_version, load_first, read_version, write_version  # noqa: F401  (snapshots, beside the row changes)


def upsert_full(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """New rows replace stored ones of the same key as a whole; among new ones the last wins."""
    latest = last_wins(incoming, keys, order).select(*stored.columns)
    return stored.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def upsert_partial(stored: DataFrame, incoming: DataFrame, keys: list[str], replace: list[str] = (), keep_if_null: list[str] = (), order: Column | None = None) -> DataFrame:
    """Only some columns of a stored row are refreshed: ``replace`` always, ``keep_if_null`` when the new value is not null.

    Of new rows with the same key the last by ``order`` counts, without an order the greatest as a whole.
    """
    fresh = _one_per_key(incoming, keys, order)
    fresh = fresh.select(*keys, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("_new"))
    old = stored.withColumn("_old", F.lit(True))
    joined = old.join(fresh, keys, "full")

    def value(c: str) -> Column:
        if f"new_{c}" not in joined.columns:
            return F.col(c)
        if c in keep_if_null:
            return F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c)
        use_new = F.col("_old").isNull() | (F.col("_new").isNotNull() if c in replace else F.lit(False))
        return F.when(use_new, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[value(c) for c in stored.columns if c not in keys])


def _one_per_key(rows: DataFrame, keys: list[str], order: Column | None, last: bool = True) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.select(*keys).distinct()
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*others), F.struct(*others) if order is None else order).alias("one")).select(*keys, "one.*")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """New keys only. Of new rows with the same key the first by ``order`` comes in, without an order the least as a whole."""
    once = _one_per_key(incoming, keys, order, last=False)
    return stored.unionByName(once.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """All children of the touched parents are replaced by the new ones."""
    touched = (incoming if parents is None else parents).select(parent).distinct()
    return stored.join(touched, parent, "left_anti").unionByName(incoming.dropDuplicates().select(*stored.columns))


def feed_health(feeds: DataFrame, polls: DataFrame) -> DataFrame:
    """Feeds after a round of polls: errors reset or counted, newest item time kept, tags of the server kept if none came.

    polls: feed_url, ok, fetched_at, latest_item_at, etag.
    """
    joined = feeds.join(polls.toDF("feed_url", "ok", "fetched_at", "latest_item_at", "new_etag"), "feed_url", "left")
    polled = F.col("ok").isNotNull()
    errors = F.when(polled, F.when(F.col("ok"), F.lit(0)).otherwise(F.col("error_count") + 1)).otherwise(F.col("error_count"))
    return joined.select("feed_url", errors.alias("error_count"), F.coalesce("fetched_at", "last_fetched_at").alias("last_fetched_at"),
                         F.greatest("last_item_at", "latest_item_at").alias("last_item_at"), F.coalesce("new_etag", "etag").alias("etag"),
                         (errors >= MAX_FEED_ERRORS).alias("paused"))


def status_machine(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending items with an answer become ingested or rejected; unanswered ones stay pending. verdicts: item_id, about."""
    joined = items.join(verdicts.withColumn("_answered", F.lit(True)), "item_id", "left")
    decided = locality(F.col("about"), F.col("country"))
    moved = F.when(decided["is_local"], F.lit("ingested")).otherwise(F.lit("rejected"))
    due = (F.col("status") == "pending") & F.col("_answered").isNotNull()
    # Both columns are set at once, from the status before.
    return joined.withColumns({"status": F.when(due, moved).otherwise(F.col("status")), "reason": F.when(due, decided["reason"])}).drop("_answered", "about")


def retention(events: DataFrame, as_of: Column, cutoff: Column, window: str) -> DataFrame:
    """Events before the cutoff are archived; those archived longer than the window before it are gone."""
    archived = F.when((F.col("occurred_at") < cutoff) & F.col("archived_at").isNull(), as_of).otherwise(F.col("archived_at"))
    marked = events.withColumn("archived_at", archived)
    return marked.filter(F.col("archived_at").isNull() | (F.col("archived_at") >= cutoff - F.expr(f"INTERVAL {window}")))


def news_to_event(news: DataFrame) -> DataFrame:
    """News items in the shape of events. Input: id, source, layer_id, title, summary, occurred_at, lat, lng, significance, specificity, links."""
    from ..functions.score import geo_precision_from_specificity
    return news.select(
        F.col("id").alias("event_id"), "source", F.when(F.contains("id", F.lit(":")), F.regexp_replace("id", "^[^:]*:", "")).otherwise(F.col("id")).alias("source_event_id"),
        F.coalesce("layer_id", F.lit("news")).alias("category"), "title", "summary", F.try_element_at("links", F.lit(1))["url"].alias("info_url"), "occurred_at", "lng", "lat",
        geo_precision_from_specificity(F.col("specificity")).alias("geo_precision"), F.lit("gemini").alias("geo_source"), F.coalesce("significance", F.lit(50.0)).alias("significance"))


def promote_local(items: DataFrame) -> DataFrame:
    """Local stories as events. Input: enriched items with coordinates (see ``geocode_fallback``) and answers (about, new_title, …)."""
    decided = locality(F.col("about"), F.col("country"))
    title = F.trim(F.coalesce(X.blank_to_null(F.col("new_title")), F.col("title")))
    layer = F.when(F.col("new_layer_id").isin([x for x in LAYERS if x not in ("volcano", "famine", "strategic_development")]), F.col("new_layer_id")).otherwise(F.lit("news"))
    significance = F.when(F.col("new_significance").between(0, 100), F.col("new_significance").cast("double")).otherwise(F.lit(DEFAULT_LOCAL_SIGNIFICANCE))
    return items.filter(decided["is_local"]).select(
        F.concat(F.lit("rss:"), F.substring("item_id", 1, 20)).alias("event_id"), F.lit("rss").alias("source"), F.col("item_id").alias("source_event_id"), layer.alias("category"),
        title.alias("title"), F.coalesce(X.blank_to_null(F.col("new_summary")), F.col("summary")).alias("summary"), F.coalesce("published_at", "fetched_at").alias("occurred_at"),
        "lat", "lng", "geo_precision", "geo_source", significance.alias("significance"), F.col("country").alias("country_iso3"), "publisher_id",
        F.coalesce("new_language", "language").alias("language"), F.when(F.col("title") != title, F.col("title")).alias("original_title"))


# ---------------------------------------------------------------- batches and versions

def with_lineage(rows: DataFrame, batch_id: Column) -> DataFrame:
    return rows.withColumn("raw_ref", F.concat(F.lit("raw.ingest_batch:"), batch_id))


def record_batch(spark: SparkSession, source: str, pulled_at: Column, payload: Column) -> DataFrame:
    """One bronze row for a pull."""
    return spark.range(1).select(F.uuid().alias("batch_id"), F.lit(source).alias("source"), pulled_at.alias("pulled_at"), payload.alias("payload"))


# Snake or upper case column names to the served names.
SERVED_NAMES = {
    "id": "id", "source": "source", "source_url": "sourceUrl", "image_url": "imageUrl", "layer_id": "layerId", "subtype": "subtype", "title": "title",
    "summary": "summary", "occurred_at": "occurredAt", "updated_at": "updatedAt", "ended_at": "endedAt", "lng": "lng", "lat": "lat", "alt_m": "altM",
    "geo_precision": "geoPrecision", "geo_source": "geoSource", "weight": "weight", "significance": "significance", "country_iso3": "countryIso3",
    "keywords": "keywords", "entities": "entities", "raw_ref": "rawRef", "tags": "tags", "attributes": "attributes", "citations": "citations",
    "source_id": "sourceId", "target_id": "targetId", "relation": "relation", "confidence": "confidence", "rationale": "rationale", "model": "model",
}


def alias_normalise(rows: DataFrame) -> DataFrame:
    """Columns by their served names; times as ISO text, decimals as doubles."""
    bare = {k.replace("_", ""): v for k, v in SERVED_NAMES.items()}
    out = []
    for name, kind in rows.dtypes:
        served = bare.get(name.lower().replace("_", ""), name)
        value = F.col(name)
        if kind.startswith("timestamp"):
            value = F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif kind.startswith("decimal"):
            value = value.cast("double")
        out.append(value.alias(served))
    return rows.select(*out)
