"""Upserts, status changes, retention, snapshots and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import merge as op
from ..operators import tables
from ..operators import validate as va
from ..operators.dedup import last_wins

from ..session import scratch_path
from .adapter import AS_OF
from .registry import query

c = F.col
NTZ = lambda text: F.lit(text).cast("timestamp_ntz")


def stored_events(v):
    """Two thirds of the events, as they were stored before."""
    return v.ev.filter("event_id % 3 <> 0").select("source", "event_id", "title", "value", "image_url")


def incoming_events(v):
    """Half of the events come again, some twice: the later copy has a higher seq and another value."""
    once = v.ev.filter("event_id % 2 = 0").select("source", "event_id", F.concat("title", F.lit("!")).alias("title"), (c("value") + 1).alias("value"), F.lit(None).cast("string").alias("image_url"), F.lit(1).alias("seq"))
    again = v.ev.filter("event_id % 8 = 0").select("source", "event_id", "title", (c("value") + 2).alias("value"), "image_url", F.lit(2).alias("seq"))
    return once.unionByName(again)


_NEW = "nw AS (SELECT source, event_id, CASE WHEN event_id%8=0 THEN title ELSE title || '!' END AS title, value + CASE WHEN event_id%8=0 THEN 2 ELSE 1 END AS value, CASE WHEN event_id%8=0 THEN image_url END AS image_url FROM ev WHERE event_id%2=0), od AS (SELECT * FROM ev WHERE event_id%3<>0)"
KEYS = ["source", "event_id"]


@query("upsert_full", f"WITH {_NEW} SELECT source, event_id, title, ROUND(value, 4) AS value, image_url FROM nw UNION ALL SELECT source, event_id, title, ROUND(value, 4), image_url FROM od WHERE event_id NOT IN (SELECT event_id FROM nw)")
def upsert_full(v):
    """A table in buckets: the stored rows, then the two polls as they come in."""
    root, bucket = scratch_path(v.spark, "keyed"), tables.by_hash(KEYS, 16)
    tables.change(v.spark, root, lambda _: stored_events(v), bucket, stored_events(v))
    for poll in (1, 2):
        batch = incoming_events(v).filter(c("seq") == poll)
        tables.change(v.spark, root, lambda stored: op.upsert_full(stored, batch, KEYS, c("seq")), bucket, batch)
    out = tables.read_version(v.spark, root)
    return out.select("source", "event_id", "title", F.round("value", 4).alias("value"), "image_url")


@query("upsert_partial", f"WITH {_NEW} SELECT COALESCE(o.source, n.source) AS source, COALESCE(o.event_id, n.event_id) AS event_id, CASE WHEN o.event_id IS NULL THEN n.title ELSE o.title END AS title, ROUND(CASE WHEN n.event_id IS NULL THEN o.value ELSE n.value END, 4) AS value, COALESCE(n.image_url, o.image_url) AS image_url FROM od o FULL JOIN nw n ON o.event_id = n.event_id")
def upsert_partial(v):
    """Value always refreshed, image kept when the new one is null, title never touched."""

    latest = last_wins(incoming_events(v), KEYS, c("seq")).drop("seq")
    out = op.upsert_partial(stored_events(v), latest, KEYS, ["value"], ["image_url"])
    return out.select("source", "event_id", "title", F.round("value", 4).alias("value"), "image_url")


@query("upsert_coalesce", f"WITH {_NEW} SELECT o.event_id, COALESCE(n.image_url, o.image_url) AS image_url FROM od o LEFT JOIN nw n USING (event_id) UNION ALL SELECT event_id, image_url FROM nw WHERE event_id%3=0")
def upsert_coalesce(v):

    latest = last_wins(incoming_events(v), KEYS, c("seq")).select(*KEYS, "image_url")
    return op.upsert_partial(stored_events(v).select(*KEYS, "image_url"), latest, KEYS, keep_if_null=["image_url"]).select("event_id", "image_url")


@query("insert_absent", "SELECT link_id, confidence FROM ev_link WHERE seq%3 <> 0 UNION ALL SELECT link_id, 0.5::DOUBLE FROM ev_link WHERE seq%3 = 0 AND seq%2 = 0")
def insert_absent(v):
    stored = v.ev_link.filter("seq % 3 <> 0").select("link_id", "confidence")
    incoming = v.ev_link.filter("seq % 2 = 0").select("link_id", F.lit(0.5).alias("confidence"))
    return op.insert_absent(stored, incoming, ["link_id"])


@query("link_upsert", "SELECT link_id, source_id, target_id, CASE WHEN seq%2=0 THEN 'mentions' ELSE relation END AS relation, CASE WHEN seq%2=0 THEN 0.5 ELSE confidence END::DOUBLE AS confidence FROM ev_link WHERE seq%3 <> 0 OR seq%2 = 0")
def link_upsert(v):
    """Relation and confidence are replaced; the ends of a stored link stay."""
    cols = ["link_id", "source_id", "target_id", "relation", "confidence"]
    stored = v.ev_link.filter("seq % 3 <> 0").select(*cols)
    incoming = v.ev_link.filter("seq % 2 = 0").select("link_id", "source_id", "target_id", F.lit("mentions").alias("relation"), F.lit(0.5).alias("confidence"))
    return op.upsert_partial(stored, incoming, ["link_id"], ["relation", "confidence"])


@query("directory_upsert", "SELECT publisher_id, CASE WHEN r IN ('ASIA','EUROPE') THEN 'New ' || name ELSE name END AS name, CASE WHEN stored THEN status ELSE 'pending' END AS status FROM (SELECT *, country AS r, publisher_id <> 'src3' AS stored FROM publisher) WHERE stored OR r IN ('ASIA','EUROPE')")
def directory_upsert(v):
    """Names are refreshed, the review status of known publishers stays."""
    stored = v.publisher.filter("publisher_id <> 'src3'").select("publisher_id", "name", "status")
    incoming = v.publisher.filter("country IN ('ASIA','EUROPE')").select("publisher_id", F.concat(F.lit("New "), "name").alias("name"), F.lit("pending").alias("status"))
    return op.upsert_partial(stored, incoming, ["publisher_id"], ["name"])


@query("replace_children", "SELECT id, tag FROM (SELECT id, unnest(list_distinct(string_split(title, ' '))) AS tag, event_id FROM ev) WHERE event_id%4 <> 0 UNION ALL SELECT id, source FROM ev WHERE event_id%4 = 0")
def replace_children(v):
    stored = v.ev.select("id", F.explode(F.array_distinct(F.split("title", " "))).alias("tag"))
    return op.replace_children(stored, v.ev.filter("event_id % 4 = 0").select("id", c("source").alias("tag")), "id")


@query("feed_health", f"""SELECT feed_url, CASE WHEN feed_key%3=0 THEN error_count WHEN feed_key%3=1 THEN 0 ELSE error_count+1 END AS error_count, CASE WHEN feed_key%3=0 THEN last_fetched_at ELSE TIMESTAMP '{AS_OF}' END AS last_fetched_at,
  CASE WHEN feed_key%3=1 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END AS last_item_at, CASE WHEN feed_key%3<>0 AND feed_key%2=0 THEN 'new' ELSE 'old' END AS etag,
  CASE WHEN feed_key%3=0 THEN error_count WHEN feed_key%3=1 THEN 0 ELSE error_count+1 END >= 5 AS paused FROM feed""")
def feed_health(v):
    feeds = v.feed.select("feed_url", "error_count", "last_fetched_at", NTZ("2024-01-20 00:00:00").alias("last_item_at"), F.lit("old").alias("etag"))
    ok = c("feed_key") % 3 == 1
    polls = v.feed.filter("feed_key % 3 <> 0").select("feed_url", ok.alias("ok"), v.as_of.alias("fetched_at"), F.when(ok, NTZ("2024-01-30 00:00:00")).alias("latest"), F.when(c("feed_key") % 2 == 0, F.lit("new")).alias("etag"))
    return op.feed_health(feeds, polls).withColumn("error_count", c("error_count").cast("bigint"))


@query("status_machine", """SELECT item_id, CASE WHEN doc_id%5=0 THEN 'duplicate' WHEN doc_id%4=0 THEN 'pending' WHEN doc_id%3=0 THEN 'ingested' ELSE 'rejected' END AS status, CASE WHEN doc_id%5<>0 AND doc_id%4<>0 AND doc_id%3<>0 THEN 'about USA, publisher in ' || upper(country) END AS reason FROM feed_item""")
def status_machine(v):
    key = c("doc_id")
    items = v.feed_item.select("item_id", F.upper("country").alias("country"), F.when(key % 5 == 0, F.lit("duplicate")).otherwise(F.lit("pending")).alias("status"))
    verdicts = v.feed_item.filter("doc_id % 4 <> 0").select("item_id", F.when(key % 3 == 0, c("country")).otherwise(F.lit("usa")).alias("about"))
    return op.status_machine(items, verdicts).select("item_id", "status", "reason")


@query("retention", f"""WITH a AS (SELECT id, occurred_at, CASE WHEN event_id%4=0 THEN occurred_at + INTERVAL 1 DAY END AS arch FROM ev), m AS (SELECT id, CASE WHEN arch IS NULL AND occurred_at < TIMESTAMP '2024-01-16 00:00:00' THEN TIMESTAMP '{AS_OF}' ELSE arch END AS archived_at FROM a)
  SELECT * FROM m WHERE archived_at IS NULL OR archived_at >= TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 7 DAY""")
def retention(v):
    events = v.ev.select("id", "occurred_at", F.when(c("event_id") % 4 == 0, c("occurred_at") + F.expr("INTERVAL 1 DAY")).alias("archived_at"))
    return op.retention(events, v.as_of, NTZ("2024-01-16 00:00:00"), "7 DAYS").select("id", "archived_at")


@query("news_to_event", """SELECT id AS event_id, source, CAST(doc_id AS VARCHAR) AS source_event_id, CASE WHEN doc_id%7=0 THEN 'news' ELSE category END AS category, 'https://n.example/' || doc_id AS info_url, CASE doc_id%3 WHEN 0 THEN 'point' WHEN 1 THEN 'country' ELSE 'unknown' END AS geo_precision, COALESCE(CASE WHEN doc_id%5<>0 THEN significance END, 50.0)::DOUBLE AS significance FROM news""")
def news_to_event(v):
    key = c("doc_id")
    spec = F.when(key % 3 == 0, F.lit("precise")).when(key % 3 == 1, F.lit("country"))
    links = F.array(F.struct(F.concat(F.lit("https://n.example/"), key.cast("string")).alias("url"), F.lit("s").alias("source")))
    news = v.news.select("id", "source", F.when(key % 7 != 0, c("category")).alias("layer_id"), "title", c("title").alias("summary"), "occurred_at", "lat", "lng", F.when(key % 5 != 0, c("significance")).alias("significance"), spec.alias("specificity"), links.alias("links"))
    return op.news_to_event(news).select("event_id", "source", "source_event_id", "category", "info_url", "geo_precision", "significance")


@query("promote_local", f"""SELECT 'rss:' || substr(item_id, 1, 20) AS event_id, CASE WHEN doc_id%3=0 THEN 'sports' ELSE 'news' END AS category, CASE WHEN doc_id%2=0 THEN 'Headline ' || doc_id ELSE item_id END AS title, COALESCE(published_at, TIMESTAMP '{AS_OF}') AS occurred_at,
  CASE WHEN (doc_id*3)%150 <= 100 THEN CAST((doc_id*3)%150 AS DOUBLE) ELSE 30.0 END AS significance, CASE WHEN doc_id%2=0 THEN item_id END AS original_title FROM feed_item WHERE doc_id%4 <> 1""")
def promote_local(v):
    key = c("doc_id")
    items = v.feed_item.select(
        "item_id", "publisher_id", F.upper("country").alias("country"), c("item_id").alias("title"), F.lit("s").alias("summary"), "published_at", v.as_of.alias("fetched_at"), c("country").alias("language"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.lit("country").alias("geo_precision"), F.lit("centroid").alias("geo_source"),
        F.when(key % 4 != 1, c("country")).alias("about"), F.when(key % 2 == 0, F.concat(F.lit(" Headline "), key.cast("string"))).alias("new_title"),
        F.when(key % 3 == 0, F.lit("sports")).otherwise(F.lit("volcano")).alias("new_layer_id"), F.lit("").alias("new_summary"), (key * 3 % 150).alias("new_significance"), F.lit(None).cast("string").alias("new_language"))
    return op.promote_local(items).select("event_id", "category", "title", "occurred_at", "significance", "original_title")


@query("lineage_append", "SELECT id, 'raw.ingest_batch:b' || (event_id%5) AS raw_ref FROM ev")
def lineage_append(v):
    return op.with_lineage(v.ev.select("id", "event_id"), F.concat(F.lit("b"), (c("event_id") % 5).cast("string"))).select("id", "raw_ref")


@query("snapshot_roundtrip", "SELECT id, significance FROM ev WHERE event_id%2=1 UNION ALL SELECT id, significance + 1 FROM ev WHERE event_id%2=0")
def snapshot_roundtrip(v):
    """Two versions are written; the newer one is read back, and an empty place falls through to it."""
    root = scratch_path(v.spark, "snapshot")
    rows = v.ev.select("id", "significance", "event_id")
    op.write_version(rows, root, {"lastIngestAt": AS_OF})
    changed = F.when(c("event_id") % 2 == 0, c("significance") + 1).otherwise(c("significance"))
    op.write_version(rows.withColumn("significance", changed), root, {"lastIngestAt": AS_OF})
    found, _ = op.load_first(v.spark, [root + "-missing", root])
    return found.select("id", "significance")


@query("alias_normalise", """SELECT id, layer_id AS "layerId", strftime(date_trunc('second', occurred_at), '%Y-%m-%dT%H:%M:%SZ') AS "occurredAt", ROUND(value, 2)::DOUBLE AS "weight", country_iso3 AS "countryIso3" FROM ev""")
def alias_normalise(v):
    raw = v.ev.select(c("id").alias("ID"), c("layer_id").alias("LAYER_ID"), c("occurred_at").alias("OCCURREDAT"), c("value").cast("decimal(12,2)").alias("WEIGHT"), c("country_iso3").alias("country_iso3"))
    return op.alias_normalise(raw)


_BAD = f"""CASE WHEN event_id%19=0 THEN NULL ELSE title END AS title, CASE WHEN event_id%23=0 THEN 'weather' ELSE layer_id END AS layer_id, CASE WHEN event_id%29=0 THEN 95.0 ELSE lat END AS lat, lng*1.06 AS lng"""


@query("row_validation", f"WITH b AS (SELECT id, {_BAD} FROM ev) SELECT id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN NOT lng BETWEEN -180 AND 180 THEN 'lng' END, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat' END, CASE WHEN layer_id = 'weather' THEN 'layer_id' END) AS violations FROM b WHERE title IS NULL OR NOT lng BETWEEN -180 AND 180 OR NOT lat BETWEEN -90 AND 90 OR layer_id = 'weather'")
def row_validation(v):
    rows = v.ev.select("id", "source", F.when(c("event_id") % 19 != 0, c("title")).alias("title"), F.when(c("event_id") % 23 == 0, F.lit("weather")).otherwise(c("layer_id")).alias("layer_id"),
                       F.when(c("event_id") % 29 == 0, 95.0).otherwise(c("lat")).alias("lat"), (c("lng") * 1.06).alias("lng"), "occurred_at", c("occurred_at").alias("updated_at"), F.lit("point").alias("geo_precision"), F.lit("native").alias("geo_source"), "significance")
    _, broken = va.quarantine(rows)
    return broken.select("id", F.array_join("violations", ",").alias("violations"))


@query("source_health", f"SELECT source, MAX(occurred_at) AS last_pull, CAST(SUM(event_id%50) AS BIGINT) AS events, CASE WHEN arg_max(event_id%4=0, occurred_at) THEN 'error' WHEN MAX(occurred_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 26 HOUR THEN 'ok' ELSE 'dark' END AS status FROM ev GROUP BY source")
def source_health(v):
    pulls = v.ev.select("source", c("occurred_at").alias("pulled_at"), (c("event_id") % 4 == 0).alias("failed"), (c("event_id") % 50).alias("events"))
    return va.source_health(pulls, v.as_of, 26)
