"""Candidate pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..functions import text as X
from ..operators import candidates as cd
from ..operators import pairs as op
from .adapter import WORDS
from .registry import query


def km(a: str, b: str) -> str:
    return f"2*6371.0*asin(LEAST(1.0, sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lng-{a}.lng)/2),2))))"


KM = km("a", "b")
NEWER = "(a.t_us > b.t_us OR (a.t_us = b.t_us AND a.id < b.id))"
H = 3_600_000_000


def disasters(v):
    """Hazard events of the sensor sources."""
    hazards = ["earthquake", "wildfire", "cyclone", "flood", "volcano", "drought"]
    return v.ev.filter(F.col("layer_id").isin(hazards) & F.col("source").isin("usgs", "gdacs", "firms")).select("id", "lat", "lng", "t_us", F.col("layer_id").alias("category"), "significance")


DISASTERS = "ds AS (SELECT id, lat, lng, t_us, layer_id AS category FROM ev WHERE layer_id IN ('earthquake','wildfire','cyclone','flood','volcano','drought') AND source IN ('usgs','gdacs','firms'))"


def reports(v):
    """News with the words it is said to contain: hazard words by key, since the given texts are invented."""
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("doc_id") % len(WORDS)).cast("int"))
    return v.text_news.withColumn("said", F.concat_ws(" ", "title", word))


SAID = "rp AS (SELECT id, lat, lng, t_us, title || ' ' || CASE doc_id % 24 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END AS said FROM news)"
_WORD = lambda w: f"regexp_matches(lower(said), '(^|[^a-z0-9_])({w})($|[^a-z0-9_])')"
MENTIONS = "CASE category " + " ".join(f"WHEN '{k}' THEN {_WORD('|'.join(p))}" for k, p in X.DISASTER_KEYWORDS.items()) + " ELSE false END"
KEYWORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 8))"
TOKENS = f"list_distinct(list_filter(string_split(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), ' '), lambda w: length(w) > 2 AND NOT list_contains({str(X.STOP_WORDS)}, w)))"


@query("proximity_pairs", f"SELECT a.id AS id_a, b.id AS id_b, ROUND({KM}, 3) AS km FROM ev a JOIN ev b ON b.t_us BETWEEN a.t_us - {72*H} AND a.t_us AND {NEWER} AND abs(a.lat-b.lat) < 4.6 WHERE {KM} <= 500")
def proximity_pairs(v):
    return op.proximity_pairs(v.ev.select("id", "lat", "lng", "t_us")).select("id_a", "id_b", F.round("km", 3).alias("km"))


@query("pair_cap", f"""WITH top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY significance DESC, id) AS position FROM ev QUALIFY position <= 50),
  p AS (SELECT a.id AS id_a, b.id AS id_b, a.position AS p1, b.position AS p2 FROM top a JOIN top b ON a.position < b.position WHERE abs(a.t_us-b.t_us) <= {72*H} AND {KM} <= 500)
  SELECT LEAST(id_a, id_b) AS id_a, GREATEST(id_a, id_b) AS id_b FROM p ORDER BY p1, p2 LIMIT 30""")
def pair_cap(v):
    # The list is cut to 50 events before it is numbered.
    top = v.ev.orderBy(F.desc("significance"), "id").limit(50)

    listed = top.select("id", "lat", "lng", "t_us", F.row_number().over(Window.orderBy(F.desc("significance"), "id")).alias("position"))
    return op.first_pairs(listed).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


@query("dedup_candidates", f"""WITH n AS (SELECT id, lat, lng, t_us, {TOKENS} AS toks FROM news),
  p AS (SELECT a.id AS id_a, b.id AS id_b, {KM} < 200 AS near, CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN false ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.5 END AS alike
    FROM n a JOIN n b ON b.t_us BETWEEN a.t_us - {24*H} AND a.t_us AND {NEWER})
  SELECT * FROM p WHERE near OR alike""")
def dedup_candidates(v):
    return op.dedup_candidates(v.news)


@query("title_jaccard", f"""WITH n AS (SELECT id, list_sort({TOKENS}) AS toks FROM news WHERE len({TOKENS}) > 0), s AS (SELECT toks, MIN(id) AS first_id, COUNT(*) AS n FROM n GROUP BY toks),
  p AS (SELECT a.first_id AS group_a, b.first_id AS group_b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.toks, b.toks)) AS k, len(a.toks) + len(b.toks) AS total FROM s a JOIN s b ON a.first_id < b.first_id)
  SELECT group_a, group_b, n_a, n_b, ROUND(k / (total - k), 6)::DOUBLE AS similarity FROM p WHERE k / (total - k) >= 0.5 UNION ALL SELECT first_id, first_id, n, n, 1.0::DOUBLE FROM s WHERE n > 1""")
def title_jaccard(v):
    return op.similar_groups(v.news, X.title_tokens(F.col("title")), 0.5).withColumn("similarity", F.round("similarity", 6))


@query("news_news_pairs", f"""WITH n AS (SELECT id, lat, lng, t_us, list_sort({KEYWORDS}) AS toks FROM news), s AS (SELECT toks, MIN(id) AS first_id, COUNT(*) AS n FROM n WHERE len(toks) > 0 GROUP BY toks),
  p AS (SELECT a.first_id AS id_a, b.first_id AS id_b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.toks, b.toks)) AS k, len(a.toks) + len(b.toks) AS total FROM s a JOIN s b ON a.first_id < b.first_id),
  w AS (SELECT LEAST(a.id, b.id) AS id_a, GREATEST(a.id, b.id) AS id_b, len(list_intersect(a.toks, b.toks)) AS k, len(a.toks) + len(b.toks) AS total FROM n a JOIN n b ON b.t_us BETWEEN a.t_us - {48*H} + 1 AND a.t_us AND {NEWER} WHERE {KM} < 200)
  SELECT id_a, id_b, 'keyword' AS strategy, n_a, n_b FROM p WHERE k / (total - k) >= 0.4 UNION ALL SELECT first_id, first_id, 'keyword', n, n FROM s WHERE n > 1
  UNION ALL SELECT id_a, id_b, 'place', 1, 1 FROM w WHERE total = k OR k / (total - k) < 0.4""")
def news_news_pairs(v):
    return op.news_news_pairs(v.text_news)


@query("news_topic_windows", f"SELECT a.category, a.id, COUNT(b.id) AS n FROM news a LEFT JOIN news b ON a.category = b.category AND b.t_us > a.t_us - {72*H} AND b.t_us <= a.t_us AND {NEWER} GROUP BY a.category, a.id")
def news_topic_windows(v):
    return op.topic_windows(v.news).select("category", "id", "n")


@query("news_disaster_pairs", f"WITH {SAID}, {DISASTERS} SELECT a.id AS news_id, b.id AS disaster_id, ROUND({KM}, 3) AS km, {MENTIONS} AS mentions FROM rp a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {KM} <= 500")
def news_disaster_pairs(v):
    return op.news_disaster_pairs(reports(v), disasters(v)).select("news_id", "disaster_id", F.round("km", 3).alias("km"), "mentions")


@query("news_mention_windows", f"WITH {SAID}, {DISASTERS} SELECT a.id AS news_id, b.category, COUNT(*) AS n FROM rp a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {MENTIONS} GROUP BY ALL")
def news_mention_windows(v):
    return op.mention_windows(reports(v), disasters(v)).select("news_id", "category", "n")


_HAZ = "CASE b.category " + " ".join(
    f"WHEN '{k}' THEN len(list_filter(a.kw, lambda t: len(list_filter({names}, lambda n: contains(t, n) OR contains(n, t))) > 0))" for k, names in X.STRICT_DISASTER_KEYWORDS.items()) + " ELSE 0 END"


def worded_reports(v):
    """News whose keywords are two words by key (the given texts hold no hazard words)."""
    pick = lambda m, k: F.get(F.array(*[F.lit(w) for w in WORDS]), ((F.col("doc_id") * m + k) % len(WORDS)).cast("int"))
    return v.news.withColumn("keywords", F.array(pick(1, 0), pick(5, 3)))


_PICK = lambda e: f"CASE ({e}) % 24 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


@query("strict_news_disaster", f"""WITH wn AS (SELECT id, lat, lng, t_us, [{_PICK('doc_id')}, {_PICK('doc_id*5+3')}] AS kw FROM news), {DISASTERS},
  p AS (SELECT a.id AS news_id, b.id AS disaster_id, {KM} AS km, LEAST(1.0, {_HAZ} / 3.0) AS overlap FROM wn a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {KM} <= 500)
  SELECT news_id, disaster_id, ROUND(km, 3) AS km, ROUND(overlap, 4)::DOUBLE AS overlap FROM p WHERE overlap >= 0.3""")
def strict_news_disaster(v):
    return op.strict_news_disaster(worded_reports(v), disasters(v)).select("news_id", "disaster_id", F.round("km", 3).alias("km"), F.round("overlap", 4).alias("overlap"))


@query("strict_news_news", f"SELECT a.id AS id_a, b.id AS id_b, ROUND({KM}, 3) AS km FROM news a JOIN news b ON b.t_us BETWEEN a.t_us - {48*H} AND a.t_us AND {NEWER} WHERE {KM} <= 200")
def strict_news_news(v):
    return op.strict_news_news(v.news).select("id_a", "id_b", F.round("km", 3).alias("km"))


RULES = [("aftershock", "earthquake", "earthquake", 300.0, 10), ("secondary-fire", "wildfire", "wildfire", 150.0, 7), ("surge-flood", "cyclone", "flood", 400.0, 5)]
_CASCADE = " UNION ALL ".join(f"SELECT '{r}' AS relation, b.id AS cause_id, a.id AS effect_id, ROUND({KM}, 3) AS km FROM ds a JOIN ds b ON a.t_us - b.t_us BETWEEN 1 AND {d*24*H} WHERE a.category = '{e}' AND b.category = '{c}' AND {KM} <= {k}" for r, c, e, k, d in RULES)


@query("hazard_cascade_pairs", f"WITH {DISASTERS} {_CASCADE}")
def hazard_cascade_pairs(v):
    return op.cascade_pairs(disasters(v), RULES).select("relation", "cause_id", "effect_id", F.round("km", 3).alias("km"))


@query("pair_batches", f"""WITH {DISASTERS}, p AS (SELECT a.id AS news_id, b.id AS disaster_id, b.t_us FROM news a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {KM} <= 500),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY news_id ORDER BY t_us DESC, disaster_id) AS rn FROM p)
  SELECT news_id, CAST((rn-1)//10 AS BIGINT) AS batch, string_agg(disaster_id, ',' ORDER BY rn) AS items FROM r GROUP BY ALL""")
def pair_batches(v):
    out = op.near_batches(v.news, disasters(v), 500.0, 7 * op.DAY, 10)
    return out.select(F.col("id").alias("news_id"), "batch", F.array_join("items", ",").alias("items"))


@query("link_run_summary", f"""WITH {SAID}, {DISASTERS}, c AS (SELECT a.id, COUNT(*) AS n FROM rp a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {KM} <= 500 OR {MENTIONS} GROUP BY a.id)
  SELECT COUNT(*) AS news, CAST(SUM(n) AS BIGINT) AS candidates, CAST(SUM((n+9)//10) AS BIGINT) AS batches FROM c""")
def link_run_summary(v):
    news, hazards = reports(v), disasters(v)
    return op.run_summary(op.candidates_per_news(op.news_disaster_pairs(news, hazards), op.mention_windows(news, hazards)))


@query("knn_vectors", """WITH d AS (SELECT a.vec_id AS q, b.vec_id AS i, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
  SELECT CAST(q AS VARCHAR) AS id, CAST(i AS VARCHAR) AS item_id, ROUND(s, 5) AS similarity FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY s DESC, CAST(i AS VARCHAR)) <= 10""")
def knn_vectors(v):
    rows = v.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", (F.col("vec_id") % 2 == 0).alias("article"))
    best = op.nearest_vectors(rows.filter("article").drop("article"), rows.filter("NOT article").drop("article"), 10)
    return best.select("id", "item_id", F.round("similarity", 5).alias("similarity"))


@query("news_candidate_counts", f"""WITH n AS (SELECT id, lat, lng, t_us, category, {KEYWORDS} AS toks FROM news),
  p AS (SELECT a.id, len(list_intersect(a.toks, b.toks)) AS k, len(a.toks) + len(b.toks) AS total, abs(a.t_us-b.t_us) AS lag, {KM} AS km, a.category = b.category AS topic FROM n a JOIN n b ON {NEWER}),
  r AS (SELECT id, CASE WHEN k > 0 AND k / (total - k) >= 0.4 THEN 'keyword' WHEN km < 200 AND lag < {48*H} THEN 'place' WHEN topic AND lag < {72*H} THEN 'topic' END AS rule FROM p)
  SELECT n.id, COUNT(*) FILTER (rule = 'keyword') AS keyword, COUNT(*) FILTER (rule = 'place') AS place, COUNT(*) FILTER (rule = 'topic') AS topic FROM n LEFT JOIN r USING (id) GROUP BY n.id""")
def news_candidate_counts(v):
    """Pairs of news by the first rule that holds, counted from groups and ranges."""
    return cd.candidate_counts(cd.news_candidates(v.text_news))


@query("candidate_runs", f"""WITH {SAID}, {DISASTERS}, c AS (SELECT a.id AS news_id, b.category, {MENTIONS} AS named FROM rp a JOIN ds b ON a.t_us - b.t_us BETWEEN 0 AND {168*H} WHERE {KM} <= 500 OR {MENTIONS}),
  r AS (SELECT news_id, CASE WHEN named THEN category END AS category, COUNT(*) AS n FROM c GROUP BY ALL),
  o AS (SELECT *, CAST(COALESCE(SUM(n) OVER (PARTITION BY news_id ORDER BY category NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_no FROM r)
  SELECT news_id, category, first_no, n, first_no // 10 AS first_batch, (first_no + n - 1) // 10 AS last_batch FROM o""")
def candidate_runs(v):
    """Candidates of news with disasters, near or named, numbered through for batches of ten."""
    news, hazards = reports(v), disasters(v)
    return cd.candidate_runs(cd.disaster_candidates(news, hazards, op.news_disaster_pairs(news, hazards))).drop("from_pos")
