"""Filters, work lists and simple tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as op
from ..operators import hotspots as hs
from ..schema import INTERESTS, LAYER_CATEGORY, interest_dim, layer_category
from .adapter import AS_OF
from .registry import query

TEN_LAYERS = ["conflict", "protest", "politics", "world", "news", "finance", "technology", "health", "earthquake", "wildfire"]
IN_TEN = ", ".join(f"'{x}'" for x in TEN_LAYERS)
NTZ = lambda text: F.lit(text).cast("timestamp_ntz")


def fire_detections(v):
    """Events as fire detections: value is the fire power."""
    return v.ev.select(F.col("id").alias("hotspot_id"), "lat", "lng", F.col("occurred_at").alias("acq_at"), F.col("value").alias("frp"),
                       F.col("event_type").alias("satellite"), F.col("source").alias("confidence"), "event_id")


CELL = "round_even(lat/0.5, 0)*0.5 + CAST(0 AS DOUBLE) AS cell_lat, round_even(lng/0.5, 0)*0.5 + CAST(0 AS DOUBLE) AS cell_lng, CAST(occurred_at AS DATE) AS acq_date"
CLUSTERS = f"""clustered AS (SELECT cell_lat, cell_lng, acq_date, COUNT(*) AS n, MAX(value) AS mx, AVG(value) AS mean, MAX(occurred_at) AS last_at,
  arg_min(event_type, (-value, id)) AS satellite FROM (SELECT *, {CELL} FROM ev) GROUP BY ALL HAVING COUNT(*) >= 8 OR MAX(value) >= 20)"""


@query("hotspot_clusters", f"""WITH {CLUSTERS} SELECT 'firms-cluster:' || strftime(acq_date, '%Y-%m-%d') || ':' || format('{{:.1f}}', cell_lat) || ':' || format('{{:.1f}}', cell_lng) AS cluster_id,
  acq_date, cell_lat, cell_lng, n AS hotspot_count, mx AS max_frp, ROUND(mean, 4) AS mean_frp, last_at AS occurred_at, LEAST(100, mx) AS significance, satellite FROM clustered""")
def hotspot_clusters(v):
    c = hs.hotspot_clusters(fire_detections(v), ("satellite",))
    return c.select(F.col("event_id").alias("cluster_id"), "acq_date", "cell_lat", "cell_lng", "hotspot_count", "max_frp",
                    F.round("mean_frp", 4).alias("mean_frp"), "occurred_at", "significance", "satellite")


@query("hotspot_members", f"""WITH {CLUSTERS}, cells AS (SELECT id, {CELL} FROM ev)
  SELECT c.id AS hotspot_id, CASE WHEN k.n IS NOT NULL THEN 'firms-cluster:' || strftime(c.acq_date, '%Y-%m-%d') || ':' || format('{{:.1f}}', c.cell_lat) || ':' || format('{{:.1f}}', c.cell_lng) END AS cluster_id
  FROM cells c LEFT JOIN clustered k USING (cell_lat, cell_lng, acq_date)""")
def hotspot_members(v):
    hotspots = fire_detections(v)
    members = hs.hotspot_members(hotspots.drop("event_id"), hs.hotspot_clusters(hotspots))
    return members.select("hotspot_id", F.col("event_id").alias("cluster_id"))


@query("event_filter", f"""SELECT id, layer_id, significance, occurred_at FROM ev WHERE layer_id IN ({IN_TEN}) AND significance >= 30
  AND occurred_at >= TIMESTAMP '2024-01-05 00:00:00' AND occurred_at < TIMESTAMP '2024-01-20 00:00:00'""")
def event_filter(v):
    return op.event_filter(v.ev, TEN_LAYERS, 30.0, NTZ("2024-01-05 00:00:00"), NTZ("2024-01-20 00:00:00")).select(
        "id", "layer_id", "significance", "occurred_at")


@query("feed_stage1", f"""SELECT id, layer_id, significance, occurred_at FROM ev WHERE layer_id IN ({IN_TEN}) AND significance >= 30
  AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY occurred_at DESC, id LIMIT 5000""")
def feed_stage1(v):
    return op.feed_stage1(v.ev, TEN_LAYERS, 30.0, v.as_of).select("id", "layer_id", "significance", "occurred_at")


HAZARDS = ", ".join(f"'{k}'" for k, c in LAYER_CATEGORY.items() if c == "hazards")


@query("feed_candidates", f"SELECT id, source, layer_id FROM ev WHERE source <> 'firms' AND layer_id NOT IN ({HAZARDS})")
def feed_candidates(v):
    return op.feed_candidates(v.ev).select("id", "source", "layer_id")


@query("feeds_due", f"""SELECT feed_url, publisher_id, country FROM feed JOIN publisher USING (publisher_id)
  WHERE status = 'approved' AND error_count < 5 AND (last_fetched_at IS NULL OR TIMESTAMP '{AS_OF}' - last_fetched_at >= INTERVAL 1 MINUTE * poll_minutes)""")
def feeds_due(v):
    return op.due_feeds(v.feed, v.publisher, v.as_of).select("feed_url", "publisher_id", "country")


@query("recency_window", f"""SELECT item_id, published_at FROM feed_item WHERE published_at IS NULL
  OR (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND published_at <= TIMESTAMP '{AS_OF}' + INTERVAL 2 HOUR)""")
def recency_window(v):
    return v.feed_item.filter(op.window_verdict(F.col("published_at"), v.as_of)).select("item_id", "published_at")


def page_titles(v):
    """Pages with their title text; words and folders that mark junk occur in some by key."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    marked = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("Your Horoscope: "), title)).otherwise(title)
    url = F.when(F.col("page_id") % 10 == 1, F.regexp_replace("url", "/(en|fr|de|es)/", "/puzzles/")).otherwise(F.col("url"))
    return v.pages.select("page_id", marked.alias("title"), url.alias("url"))


@query("junk_filter", r"""WITH t AS (SELECT page_id, CASE WHEN page_id%10=0 THEN 'Your Horoscope: ' ELSE '' END || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id%10=1 THEN regexp_replace(url, '/(en|fr|de|es)/', '/puzzles/') ELSE url END AS url FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(title, '(?i)\b(horoscope|sponsored|advertorial|partner content|crossword|sudoku|wordle|quiz of the|deal of the day|coupon|promo code|best deals?)\b') THEN 'junk title'
   WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)/(sponsored|advertorial|partner-content|horoscopes?|puzzles?|crosswords?|deals|coupons?|podcasts?)(/|$)') THEN 'junk path' END AS reason FROM t""")
def junk_filter(v):
    return page_titles(v).select("page_id", op.junk_reason(F.col("title"), F.col("url")).alias("reason"))


@query("news_with_keywords", """SELECT id, len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 8))) AS n_keywords
  FROM news WHERE source IN ('gnews','wikifeeds') AND len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 8)) > 0""")
def news_with_keywords(v):
    return op.news_with_keywords(v.text_news).select("id", F.size("keywords").cast("bigint").alias("n_keywords"))


@query("missing_image_worklist", "SELECT id, source, significance FROM ev WHERE source IN ('gnews','wikifeeds','conflict_csv','usgs','gdacs') AND image_url IS NULL")
def missing_image_worklist(v):
    return op.missing_images(v.ev).select("id", "source", "significance")


@query("missing_coords_skip", "SELECT source, COUNT(*) FILTER (event_id % 17 <> 3) AS kept, COUNT(*) FILTER (event_id % 17 = 3) AS skipped FROM ev GROUP BY source")
def missing_coords_skip(v):
    gaps = v.ev.withColumn("lat", F.when(F.col("event_id") % 17 != 3, F.col("lat")))
    return op.coordinate_tally(gaps, "source")


@query("link_filter", """SELECT link_id, CASE WHEN relation IN ('co_occurs','same_place','same_topic','reported_together') THEN relation ELSE 'co_occurs' END AS relation, confidence
  FROM ev_link WHERE confidence >= 0.7""")
def link_filter(v):
    return op.link_filter(v.ev_link).select("link_id", "relation", "confidence")


@query("restrict_ids", "SELECT id, significance FROM ev WHERE id IN (SELECT source_id FROM ev_link WHERE confidence >= 0.9)")
def restrict_ids(v):
    allowed = v.ev_link.filter(F.col("confidence") >= 0.9).select(F.col("source_id").alias("id"))
    return op.restrict_ids(v.ev, allowed).select("id", "significance")


@query("event_lookup", "SELECT link_id, source_id, target_id, relation FROM ev_link WHERE source_id = 'ev:500' OR target_id = 'ev:500'")
def event_lookup(v):
    return op.links_touching(v.ev_link, "ev:500").select("link_id", "source_id", "target_id", "relation")


@query("viewport_top", """WITH p AS (SELECT id, event_type AS view_id, significance, (lng+180)*4 AS x, (90-lat)*4 AS y, event_id%3 <> 0 AS front FROM ev)
  SELECT view_id, id, significance FROM p WHERE front AND x > 288 AND x < 1152 AND y > 144 AND y < 576
   AND id NOT IN (SELECT event_id FROM actions WHERE kind = 'open')
  QUALIFY ROW_NUMBER() OVER (PARTITION BY view_id ORDER BY significance DESC, id) = 1""")
def viewport_top(v):
    points = v.ev.select("id", F.col("event_type").alias("view_id"), "significance", ((F.col("lng") + 180) * 4).alias("x"),
                         ((90 - F.col("lat")) * 4).alias("y"), (F.col("event_id") % 3 != 0).alias("front"))
    recent = v.actions.filter("kind = 'open'").select(F.col("event_id").alias("id")).distinct()
    return op.viewport_top(points, recent, "view_id", 1440.0, 720.0)


@query("config_validation", """SELECT id, CASE WHEN event_id%7=0 THEN 'lat and lng must be supplied together' WHEN ABS(lat) > 90 OR ABS(lng*1.06) > 180 THEN 'coordinates out of range'
   WHEN NOT (value BETWEEN 0 AND 100) THEN 'significance out of range' WHEN event_id%13=0 THEN 'keyword length' WHEN event_id%17=0 THEN 'unknown layer' WHEN event_id%19=0 THEN 'start after end' END AS violation FROM ev""")
def config_validation(v):
    e = v.ev
    key = F.col("event_id")
    words = F.when(key % 13 == 0, F.array(F.lit(" "))).otherwise(F.split("title", " "))
    layers = F.array(F.when(key % 17 == 0, F.lit("weather")).otherwise(F.col("layer_id")))
    end = F.when(key % 19 == 0, F.col("occurred_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("occurred_at") + F.expr("INTERVAL 1 DAY"))
    lng = F.when(key % 7 != 0, F.col("lng") * 1.06)
    return e.select("id", op.config_violation(F.col("lat"), lng, words, layers, F.col("occurred_at"), end, F.col("value")).alias("violation"))


@query("active_events", "SELECT id, significance FROM ev WHERE canonical_id IS NULL")
def active_events(v):
    return op.active_events(v.ev).select("id", "significance")


SEEDS = ", ".join(f"('interest:{row[0]}')" for row in INTERESTS)


@query("pending_vectors", f"""SELECT key, priority FROM (SELECT key, 0 AS priority FROM (VALUES {SEEDS}) s(key) UNION ALL SELECT id, 1 FROM ev)
  WHERE key NOT IN (SELECT key FROM vectors)""")
def pending_vectors(v):
    seeds = interest_dim(v.spark).select(F.concat(F.lit("interest:"), "interest_id").alias("key"))
    return op.pending_vectors(seeds, v.ev.select(F.col("id").alias("key")), v.vectors)


@query("retired_interests", "SELECT user_id, interest_id FROM user_interest WHERE interest_id NOT IN ('travel','arts','oceania')")
def retired_interests(v):
    catalogue = interest_dim(v.spark).filter(~F.col("interest_id").isin("travel", "arts", "oceania"))
    return op.known_interests(v.user_interest, catalogue).select("user_id", "interest_id")


@query("source_summary", "SELECT source, COUNT(*) AS n, COUNT(*) FILTER (len(regexp_extract_all(lower(text), '[a-z0-9]{8,}')) > 0) AS with_keywords FROM news GROUP BY source")
def source_summary(v):
    return v.text_news.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("keywords") > 0).alias("with_keywords"))


@query("category_counts", "SELECT category, layer_id, COUNT(*) AS n FROM ev JOIN layer_category USING (layer_id) GROUP BY ROLLUP (category, layer_id)")
def category_counts(v):
    """Totals by layer, by category and overall."""
    return v.ev.withColumn("category", layer_category(F.col("layer_id"))).rollup("category", "layer_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("load_tallies", f"""SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN length(text) < 40 THEN 'no link/title' WHEN published_at IS NOT NULL AND (published_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR
   OR published_at > TIMESTAMP '{AS_OF}' + INTERVAL 2 HOUR) THEN 'outside window' ELSE 'kept' END AS reason FROM feed_item) GROUP BY reason""")
def load_tallies(v):
    reason = (F.when(F.char_length("text") < 40, F.lit("no link/title"))
              .when(~op.window_verdict(F.col("published_at"), v.as_of), F.lit("outside window")).otherwise(F.lit("kept")))
    return v.feed_item.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("outcome_pivot", """SELECT source, COUNT(*) AS events, COUNT(*) FILTER (o='usable') AS usable, COUNT(*) FILTER (o='no_image') AS no_image, COUNT(*) FILTER (o='page_error') AS page_error,
  COUNT(*) FILTER (o='image_broken') AS image_broken FROM (SELECT source, CASE WHEN event_id%9=0 THEN 'page_error' WHEN image_url IS NULL THEN 'no_image' WHEN event_id%7=0 THEN 'image_broken' ELSE 'usable' END AS o FROM ev) GROUP BY source""")
def outcome_pivot(v):
    key = F.col("event_id")
    outcome = (F.when(key % 9 == 0, F.lit("page_error")).when(F.col("image_url").isNull(), F.lit("no_image"))
               .when(key % 7 == 0, F.lit("image_broken")).otherwise(F.lit("usable")))
    names = ["usable", "no_image", "page_error", "image_broken"]
    tallies = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    return v.ev.select("source", outcome.alias("outcome")).groupBy("source").agg(F.count(F.lit(1)).alias("events"), *tallies)


@query("last_ingest", "SELECT COALESCE(source, 'all') AS source, MAX(occurred_at) AS last_at FROM ev GROUP BY GROUPING SETS ((source), ())")
def last_ingest(v):
    return v.ev.rollup("source").agg(F.max("occurred_at").alias("last_at")).select(F.coalesce("source", F.lit("all")).alias("source"), "last_at")


@query("publisher_stats", """SELECT publisher_id, COUNT(*) AS items, arg_min(lang, doc_id) AS language, COALESCE(MAX(NULLIF(TRIM(CASE WHEN publisher_id LIKE 'src1%' THEN '' ELSE 'The ' || publisher_id END), '')), publisher_id) AS name
  FROM news GROUP BY publisher_id""")
def publisher_stats(v):
    stated = F.when(F.startswith("publisher_id", F.lit("src1")), F.lit("")).otherwise(F.concat(F.lit("The "), "publisher_id"))
    return (v.news.groupBy("publisher_id").agg(F.count(F.lit(1)).alias("items"), F.min_by("lang", "doc_id").alias("language"),
                                               F.max(F.nullif(F.trim(stated), F.lit(""))).alias("stated"))
            .select("publisher_id", "items", "language", F.coalesce("stated", "publisher_id").alias("name")))


@query("category_heatmaps", "SELECT category, COUNT(*) AS n_points, ROUND(SUM(lat), 3) AS sum_lat, ROUND(SUM(lng), 3) AS sum_lng FROM ev JOIN layer_category USING (layer_id) WHERE significance >= 50 GROUP BY category")
def category_heatmaps(v):
    """Marker points per category; categories without markers do not appear."""
    markers = op.event_filter(v.ev, None, 50.0).withColumn("category", layer_category(F.col("layer_id")))
    return markers.groupBy("category").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("lat"), 3).alias("sum_lat"), F.round(F.sum("lng"), 3).alias("sum_lng"))


@query("drop_distincts", "SELECT publisher_id, COUNT(*) AS items, COUNT(DISTINCT text) AS distinct_texts, COUNT(*) - COUNT(DISTINCT text) AS repeats FROM feed_item GROUP BY publisher_id")
def drop_distincts(v):
    """Distinct items per publisher: a hash of each text is counted, and equal texts merge before the shuffle by publisher."""
    per_text = v.feed_item.groupBy("publisher_id", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("publisher_id").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("distinct_texts"), F.sum(F.col("n") - 1).alias("repeats"))


@query("category_state", """SELECT user_id, category, CASE WHEN n_on = 0 THEN 'off' WHEN n_on = n_all THEN 'on' ELSE 'partial' END AS state FROM (
  SELECT u.user_id, c.category, COUNT(DISTINCT c.layer_id) AS n_all, COUNT(DISTINCT CASE WHEN e.layer_id IS NOT NULL THEN c.layer_id END) AS n_on
  FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN layer_category c LEFT JOIN (SELECT DISTINCT user_id, layer_id FROM ev WHERE value >= 40) e ON e.user_id = u.user_id AND e.layer_id = c.layer_id GROUP BY ALL)""")
def category_state(v):
    """Per user: which categories have all, none or some of their layers enabled."""
    enabled = v.ev.filter("value >= 40").select("user_id", "layer_id").distinct()
    per_category = enabled.groupBy("user_id").agg(F.collect_set("layer_id").alias("on"))
    users = v.ev.select("user_id").distinct().join(per_category, "user_id", "left")
    states = []
    for name in dict.fromkeys(LAYER_CATEGORY.values()):
        members = F.array(*[F.lit(k) for k, c in LAYER_CATEGORY.items() if c == name])
        on = F.size(F.array_intersect(members, F.coalesce("on", F.array().cast("array<string>"))))
        state = F.when(on == 0, F.lit("off")).when(on == F.size(members), F.lit("on")).otherwise(F.lit("partial"))
        states.append(F.struct(F.lit(name).alias("category"), state.alias("state")))
    return users.select("user_id", F.inline(F.array(*states)))
