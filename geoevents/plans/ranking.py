"""Rankings, caps, pages and latest-action selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging
from ..operators import ranking as op
from ..session import scratch_path
from .registry import query


@query("fair_pick", """WITH t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, publisher_id ORDER BY published_at DESC NULLS LAST, item_id) AS turn,
    MAX(published_at) OVER (PARTITION BY country, publisher_id) AS freshest FROM feed_item),
  p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY turn, freshest DESC NULLS LAST, publisher_id) AS pick FROM t)
  SELECT country, publisher_id, item_id, published_at, CAST(pick AS BIGINT) AS pick FROM p WHERE pick <= 30""")
def fair_pick(v):
    return op.fair_pick(v.feed_item).select("country", "publisher_id", "item_id", "published_at", F.col("pick").cast("bigint").alias("pick"))


HEADLINES = """r AS (SELECT id, layer_id, significance, category, ROW_NUMBER() OVER (PARTITION BY category ORDER BY significance DESC, id) AS k FROM ev LEFT JOIN layer_category USING (layer_id)),
  h AS (SELECT * FROM r ORDER BY CASE WHEN category IS NOT NULL AND k <= 4 THEN 0 ELSE 1 END, significance DESC, id LIMIT 30)"""


@query("headline_feed", f"WITH {HEADLINES} SELECT id, layer_id, significance FROM h")
def headline_feed(v):
    return op.headline_feed(v.ev, 30, 4).select("id", "layer_id", "significance")


@query("significance_rank", f"""WITH {HEADLINES}, k2 AS (SELECT id, ROW_NUMBER() OVER (ORDER BY significance DESC, id) AS rank FROM h)
  SELECT ev.id, COALESCE(k2.rank, 0) AS rank FROM ev LEFT JOIN k2 USING (id)""")
def significance_rank(v):
    return op.rank_among(v.ev, op.headline_feed(v.ev, 30, 4)).select("id", F.col("rank").cast("bigint").alias("rank"))


@query("top2_per_category", "SELECT layer_id, id, occurred_at FROM ev QUALIFY ROW_NUMBER() OVER (PARTITION BY layer_id ORDER BY occurred_at DESC, id) <= 2")
def top2_per_category(v):
    return op.first_k(v.ev, ["layer_id"], [F.desc("occurred_at"), F.asc("id")], 2).select("layer_id", "id", "occurred_at")


_PUBLISHERS = "p AS (SELECT n_regionkey AS country_pos, 'd' || CAST((s_suppkey*7)%60 AS VARCHAR) AS domain, MAX(s_acctbal) AS items FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"
_TAKEN = ", ".join(
    f"c{k} AS (SELECT * FROM p WHERE country_pos = {k}" + "".join(f" AND domain NOT IN (SELECT domain FROM c{j})" for j in range(k))
    + " ORDER BY items DESC, domain LIMIT 10)" for k in range(5))


@query("publisher_cap", f"WITH {_PUBLISHERS}, {_TAKEN} SELECT country_pos, domain, items FROM (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(5)) + ")")
def publisher_cap(v):
    candidates = v.supplier.join(F.broadcast(v.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("country_pos"), F.concat(F.lit("d"), (F.col("s_suppkey") * 7 % 60).cast("string")).alias("domain"), F.col("s_acctbal").alias("items"))
    return op.publisher_cap(candidates).select("country_pos", "domain", "items")


@query("click_cap", """SELECT user_id, event_id, kind, acted_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_id, kind ORDER BY acted_at DESC, seq DESC) AS rn FROM actions WHERE kind IN ('source','open'))
  WHERE rn <= CASE kind WHEN 'source' THEN 3 ELSE 1 END""")
def click_cap(v):
    return op.click_cap(v.actions).select("user_id", "event_id", "kind", "acted_at")


@query("last_500", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) <= 500")
def last_500(v):
    newest = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")]
    return op.last_interactions(v.lineitem, "l_suppkey", newest).select("l_suppkey", "l_orderkey", "l_linenumber")


def _state_actions(v):
    """Actions where clicks on the source stand for removing a save, and opens for clearing an opinion."""
    kind = F.when(F.col("kind") == "source", F.lit("unsave")).when(F.col("kind") == "open", F.lit("clear")).otherwise(F.col("kind"))
    return v.actions.withColumn("kind", kind)


@query("latest_action", """WITH gone AS (SELECT user_id, event_id, MAX(seq) AS removed FROM actions WHERE kind='source' GROUP BY ALL),
  s AS (SELECT a.user_id, a.event_id, MIN(a.acted_at) AS added_at FROM actions a LEFT JOIN gone g USING (user_id, event_id) WHERE a.kind='save' AND (g.removed IS NULL OR a.seq > g.removed) GROUP BY ALL),
  f AS (SELECT user_id, event_id, arg_max(kind, seq) AS opinion FROM actions WHERE kind IN ('more','less','open') GROUP BY ALL)
  SELECT user_id, event_id, added_at, CASE WHEN opinion <> 'open' THEN opinion END AS opinion FROM s FULL JOIN f USING (user_id, event_id) WHERE added_at IS NOT NULL OR opinion <> 'open'""")
def latest_action(v):
    actions = _state_actions(v)
    opinions = op.latest_feedback(actions).select("user_id", "event_id", F.col("kind").alias("opinion"))
    saved = op.saved_since(actions).select("user_id", "event_id", "added_at")
    return saved.join(opinions, ["user_id", "event_id"], "full")


@query("top3_terms", """WITH w AS (SELECT event_id, string_split(title, ' ') AS ws FROM ev), t AS (SELECT event_id, w, (event_id*7 + length(w)*13) % 100 AS c FROM (SELECT event_id, unnest(ws) AS w FROM w)),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY c DESC, w) AS k FROM t) SELECT event_id, string_agg(w, ',' ORDER BY k) AS top_terms FROM r WHERE k <= 3 GROUP BY event_id""")
def top3_terms(v):
    strength = lambda w: ((F.col("event_id") * 7 + F.char_length(w) * 13) % 100).cast("double")
    terms = F.transform(F.split("title", " "), lambda w: F.struct(w.alias("text"), F.lit(None).cast("double").alias("relevance"), strength(w).alias("confidence")))
    return v.ev.select("event_id", F.array_join(op.top_terms(terms), ",").alias("top_terms"))


@query("canonical_order", "SELECT id, occurred_at FROM ev ORDER BY occurred_at DESC, id")
def canonical_order(v):
    return op.canonical_order(v.ev).select("id", "occurred_at")


@query("marker_cap", "SELECT id, significance FROM ev ORDER BY significance DESC, id LIMIT 5000")
def marker_cap(v):
    return op.marker_cap(v.ev.select("id", "significance"))


@query("tour_order", "SELECT id, lat, lng FROM ev ORDER BY lat DESC, lng, id")
def tour_order(v):
    return op.tour_order(v.ev.select("id", "lat", "lng"))


_SHOWN = "id || '|' || CAST(t_us AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || layer_id || '|' || source || '|' || title || '|' || COALESCE(country_iso3, '~') || '|' || COALESCE(location, '~') || '|' || COALESCE(alert_level, '~') || '|' || COALESCE(image_url, '~') || '|' || COALESCE(canonical_id, '~')"


@query("event_page", f"""WITH f AS (SELECT CAST(SUM(CAST('0x' || substr(md5({_SHOWN}), 1, 15) AS BIGINT)) % 1152921504606846976 AS BIGINT) AS fingerprint, COUNT(*) AS total FROM ev),
  p AS (SELECT id, occurred_at FROM ev ORDER BY occurred_at DESC, id LIMIT 2000 OFFSET 2000) SELECT id, occurred_at, fingerprint, total FROM p CROSS JOIN f""")
def event_page(v):
    shown = ["id", "t_us", "user_id", "event_type", "layer_id", "source", "title", "country_iso3", "location", "alert_level", "image_url", "canonical_id"]
    root = scratch_path(v.spark, "pages")
    paging.write_snapshot(v.ev.select("occurred_at", *shown), root, shown, range_rows=2500)
    return paging.page_at(v.spark, root, 2000, 2000).select("id", "occurred_at", "fingerprint", "total")
