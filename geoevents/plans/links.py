"""Link and enrichment answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import links as op
from ..schema import LAYERS
from .adapter import WORDS, _pick
from .registry import query

c = F.col
KEY = lambda m: c("event_id") % m


@query("related_by_confidence", "SELECT id, link_id, other, confidence FROM (SELECT source_id AS id, target_id AS other, link_id, confidence FROM ev_link WHERE source_id <> target_id UNION ALL SELECT target_id, source_id, link_id, confidence FROM ev_link WHERE source_id <> target_id)")
def related_by_confidence(v):
    return graph.link_index(v.ev_link).filter("id <> other").orderBy("id", F.desc("confidence"), "link_id").select("id", "link_id", "other", "confidence")


@query("verdict_join", """SELECT i.item_id, i.doc_id // 12 AS batch_id, i.doc_id % 5 <> 0 AND i.doc_id % 7 <> 0 AS answered, CASE WHEN i.doc_id % 5 <> 0 AND i.doc_id % 7 <> 0 THEN i.lang2 END AS about FROM (SELECT *, upper(country) AS lang2 FROM feed_item) i""")
def verdict_join(v):
    """Answers come back per batch; some items get none, and some answers name an item of another batch."""
    items = v.feed_item.select("item_id", F.floor(c("doc_id") / 12).alias("batch_id"))
    answered = v.feed_item.filter("doc_id % 5 <> 0")
    astray = F.when(c("doc_id") % 7 == 0, 1).otherwise(0)
    verdicts = answered.select("item_id", (F.floor(c("doc_id") / 12) + astray).alias("batch_id"), F.upper("country").alias("about"))
    return op.verdict_join(items, verdicts, ["batch_id", "item_id"])


@query("geocode_fallback", f"""WITH g AS (SELECT id, CASE WHEN event_id%5=0 THEN '' ELSE {_pick('event_id', WORDS)} END AS place, CASE event_id%3 WHEN 0 THEN 'city' WHEN 1 THEN 'global' ELSE 'region' END AS spec, country_iso3 FROM ev),
  hit AS (SELECT *, place <> '' AND spec <> 'global' AND place < 'm' AS ok FROM g)
  SELECT id, CASE WHEN ok THEN CAST(length(place) AS DOUBLE) WHEN country_iso3 IN ('AAA','BBB') THEN 10.0 ELSE 0.0 END::DOUBLE AS lat, CASE WHEN ok THEN CAST(-length(place) AS DOUBLE) WHEN country_iso3 IN ('AAA','BBB') THEN 20.0 ELSE 0.0 END::DOUBLE AS lng,
   CASE WHEN ok THEN spec ELSE 'country' END AS geo_precision, CASE WHEN ok THEN 'openstreetmap' ELSE 'centroid' END AS geo_source FROM hit""")
def geocode_fallback(v):
    place = F.when(KEY(5) == 0, F.lit("")).otherwise(F.expr(_pick("event_id", WORDS)))
    spec = F.get(F.array(F.lit("city"), F.lit("global"), F.lit("region")), KEY(3).cast("int"))
    items = v.ev.select("id", place.alias("place"), spec.alias("specificity"), c("country_iso3").alias("country"))
    gazetteer = v.ev.select(F.expr(_pick("event_id", WORDS)).alias("place")).distinct().filter("place < 'm'").select("place", F.char_length("place").cast("double").alias("lat"), (-F.char_length("place")).cast("double").alias("lng"))
    centroids = v.country_dim.filter("country_id IN ('AAA','BBB')").select("country_id", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"))
    return op.geocode_fallback(items, gazetteer, centroids).select("id", "lat", "lng", "geo_precision", "geo_source")


MECH = ["The quake damaged the main water pipes of the town", "Both occurred in the same region at that time", "It may have been caused by heavy rain upstream", "short text", "Flood waters closed the road named in the report"]
_MECH = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MECH)) + " END"
_TYPE = "CASE event_id % 4 WHEN 0 THEN 'PRIMARY_STORY' WHEN 1 THEN 'MENTIONS' WHEN 2 THEN 'ANALYZES' END"


@query("nd_link_quality", f"""WITH q AS (SELECT event_id, id, 'ev:' || (event_id+1) AS other, CAST((event_id*53)%101 AS DOUBLE)/100 AS conf, {_MECH} AS mech, {_TYPE} AS type FROM ev)
  SELECT 'link:' || id || ':' || other AS link_id, replace(lower(COALESCE(type, 'MENTIONS')), '_', '-') AS relation, CASE WHEN type = 'PRIMARY_STORY' THEN 'merge' ELSE 'link' END AS display, conf AS confidence, mech AS rationale
  FROM q WHERE event_id % 6 <> 0 AND conf >= 0.3 AND event_id % 5 IN (0, 4) AND event_id % 3 <> 0""")
def nd_link_quality(v):
    verdicts = v.ev.select(c("id").alias("news_id"), F.concat(F.lit("ev:"), (c("event_id") + 1).cast("string")).alias("disaster_id"), (KEY(6) != 0).alias("relationship"), F.expr(_TYPE).alias("type"),
                           ((c("event_id") * 53 % 101).cast("double") / 100).alias("confidence"), F.expr(_MECH).alias("mechanism"), F.slice(F.split("title", " "), 1, KEY(3).cast("int")).alias("evidence"))
    return op.news_disaster_links(verdicts).select("link_id", "relation", "display", "confidence", "rationale")


@query("nn_link_quality", """WITH q AS (SELECT event_id, id, 'ev:' || (event_id+1) AS other, CAST((event_id*53)%101 AS DOUBLE)/100 AS conf, CAST((event_id*29)%101 AS DOUBLE)/100 AS plaus, string_split(title, ' ') AS ws, title FROM ev)
  SELECT 'link:' || id || ':' || other AS link_id, 'shares-context' AS relation, conf AS confidence, title || chr(10) || chr(10) || 'Causal chain: ' || array_to_string(ws[1:event_id%4], ' → ') || chr(10) || chr(10) || 'Evidence: ' || array_to_string(ws[1:LEAST(3, event_id%3)], '; ') AS rationale
  FROM q WHERE plaus >= 0.5 AND event_id%7 <> 0 AND conf >= 0.3 AND event_id%4 >= 2 AND (event_id%3 >= 1 OR event_id%2 >= 1)""")
def nn_link_quality(v):
    n = lambda k: F.slice(F.split("title", " "), 1, KEY(k).cast("int"))
    hypotheses = v.ev.select(c("id").alias("source_id"), F.concat(F.lit("ev:"), (c("event_id") + 1).cast("string")).alias("article_id"), F.lit("SHARES_CONTEXT").alias("type"),
                             ((c("event_id") * 29 % 101).cast("double") / 100).alias("plausibility"), n(4).alias("causal_chain"), F.when(KEY(7) != 0, F.lit(True)).alias("accept"),
                             ((c("event_id") * 53 % 101).cast("double") / 100).alias("confidence"), c("title").alias("mechanism"), n(3).alias("evidence"), n(2).alias("knowledge"))
    return op.news_news_links(hypotheses).select("link_id", "relation", "confidence", "rationale")


_LAYER2 = _pick("event_id*11", LAYERS + ["weather", "unknown"])


@query("enrichment_merge", f"""WITH a AS (SELECT *, event_id%3 <> 0 AS got, {_LAYER2} AS l2, (event_id*7)%130 - 10 AS s2 FROM ev)
  SELECT id, CASE WHEN got AND l2 NOT IN ('weather','unknown') THEN l2 ELSE layer_id END AS layer_id, CASE WHEN got AND event_id%4 <> 0 THEN 'new ' || title ELSE title END AS summary,
   CASE WHEN got AND s2 BETWEEN 0 AND 100 THEN CAST(s2 AS DOUBLE) ELSE significance END AS significance, CASE WHEN got AND event_id%5 <> 0 THEN event_type ELSE '' END AS keywords,
   CASE WHEN event_id%2=0 OR NOT got THEN 'unset' WHEN event_id%7=0 THEN 'global' ELSE 'city' END AS specificity FROM a""")
def enrichment_merge(v):
    events = v.ev.select("id", "layer_id", c("title").alias("summary"), "significance", F.array().cast("array<string>").alias("keywords"), F.when(KEY(2) == 0, F.lit("native")).otherwise(F.lit("llm_hint")).alias("geo_source"), F.lit("unset").alias("specificity"))
    answers = v.ev.filter("event_id % 3 <> 0").select(
        "id", F.expr(_LAYER2).alias("new_layer_id"), F.when(KEY(4) != 0, F.concat(F.lit("new "), "title")).otherwise(F.lit("")).alias("new_summary"), (c("event_id") * 7 % 130 - 10).alias("new_significance"),
        F.when(KEY(5) != 0, F.array("event_type")).alias("new_keywords"), F.when(KEY(7) != 0, F.lit("city")).alias("new_specificity"), F.lit(True).alias("answered"))
    out = op.enrichment_merge(events, answers)
    return out.select("id", "layer_id", "summary", "significance", F.array_join("keywords", ",").alias("keywords"), "specificity")


@query("locality_verdict", """SELECT item_id, CASE doc_id%4 WHEN 3 THEN NULL WHEN 0 THEN upper(country) ELSE 'GBR' END AS about, doc_id%4 = 0 AS is_local, CASE doc_id%4 WHEN 0 THEN NULL WHEN 3 THEN 'international story, no single country' ELSE 'about GBR, publisher in ' || upper(country) END AS reason FROM feed_item""")
def locality_verdict(v):
    about = F.when(c("doc_id") % 4 == 0, F.concat(F.lit(" "), c("country"))).when(c("doc_id") % 4 != 3, F.lit("gbr"))
    verdict = op.locality(about, F.upper("country"))
    return v.feed_item.select("item_id", verdict["about"].alias("about"), verdict["is_local"].alias("is_local"), verdict["reason"].alias("reason"))
