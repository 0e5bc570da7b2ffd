"""Countries: location, borders, headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import country as op
from ..operators import graph
from .adapter import ALIAS_PLACES, COUNTRIES
from .registry import query

_BOX = lambda b: f"(x BETWEEN {b[0]} AND {b[2]} AND lat BETWEEN {b[1]} AND {b[3]})"
_IN = lambda rings: _BOX(rings[0]) + "".join(f" AND NOT {_BOX(h)}" for h in rings[1:])
_POINTS = "pt AS (SELECT *, CASE WHEN lng >= 180 THEN lng - 360 WHEN lng < -180 THEN lng + 360 ELSE lng END AS x FROM ev)"
_CONTAINS = " UNION ALL ".join(
    f"SELECT id, '{c}' AS country_id, {i} AS position FROM pt WHERE " + " OR ".join(f"({_IN(rings)})" for rings in parts) for i, (c, _n, parts) in enumerate(COUNTRIES))
UNDER = f"{_POINTS}, inn AS ({_CONTAINS}), un AS (SELECT id, arg_min(country_id, position) AS under FROM inn GROUP BY id)"
_WRAP = lambda d: f"(({d}) + 540 - 360*floor((({d}) + 540)/360) - 180)"
# Distance beside the line of an edge and beyond its ends, in the plane of the position.
COAST = f"""ed AS (SELECT p.id, e.country_id, d.position, {_WRAP('e.x1 - p.x')} * cos(radians(p.lat)) AS east, e.y1 - p.lat AS north, {_WRAP('e.x2 - e.x1')} * cos(radians(p.lat)) AS run, e.y2 - e.y1 AS rise
    FROM pt p JOIN country_edge e ON e.ring = 0 JOIN country_dim d ON d.country_id = e.country_id),
  ln AS (SELECT *, sqrt(run*run + rise*rise) AS size FROM ed),
  ds AS (SELECT id, country_id, position, CASE WHEN size = 0 THEN east*east + north*north ELSE pow((east*rise - north*run) / size, 2) + pow(GREATEST((east*run + north*rise) / size, -(east*run + north*rise) / size - size, 0), 2) END AS square FROM ln),
  co AS (SELECT id, country_id AS coast, sqrt(ROUND(square, 12)) AS degrees FROM ds WHERE ROUND(square, 12) < 6.25 QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY ROUND(square, 12), position, country_id) = 1)"""
KEYWORD = "CASE WHEN event_id % 6 = 2 THEN CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '21 km NE of Lae, {n}'" for i, n in enumerate(ALIAS_PLACES)) + " END END"
NAMED = f"""nm AS (SELECT id, coalesce(location || ',', '') || coalesce({KEYWORD}, '') AS txt FROM ev),
  pc AS (SELECT id, generate_subscripts(string_split(txt, ','), 1) AS pos, lower(trim(regexp_replace(unnest(string_split(txt, ',')), '\\(.*?\\)', '', 'g'))) AS name FROM nm),
  nd AS (SELECT pc.id, arg_min(d.country_id, pos) AS named FROM pc JOIN country_dim d ON lower(d.name) = pc.name GROUP BY pc.id)"""


def located(v):
    return v.ev.select("*", F.array_compact(F.array(F.expr(KEYWORD))).alias("place_keywords"))


@query("point_in_polygon", f"WITH {UNDER} SELECT DISTINCT id, country_id FROM inn")
def point_in_polygon(v):
    return v.ev.join(op.containing(v.ev, v.country_edge), ["lat", "lng"]).select("id", "country_id")


@query("nearest_coast", f"WITH {_POINTS}, {COAST} SELECT id, coast, ROUND(degrees, 5) AS degrees FROM co")
def nearest_coast(v):
    return v.ev.join(op.nearest_coast(v.ev, v.country_edge, v.country_dim), ["lat", "lng"]).select("id", "coast", F.round("degrees", 5).alias("degrees"))


@query("place_name_country", f"WITH {NAMED} SELECT id, named FROM nd")
def place_name_country(v):
    names = located(v).select("id", op.place_names(F.col("location"), F.col("place_keywords")).alias("names"))
    return op.named_country(names, v.country_dim)


@query("stated_country", "SELECT id, country_id, name FROM ev LEFT JOIN country_dim ON country_iso3 = country_id")
def stated_country(v):
    return v.ev.join(v.country_dim, F.col("country_iso3") == F.col("country_id"), "left").select("id", "country_id", "name")


EVENT_COUNTRY = f"""{UNDER}, {COAST}, {NAMED}, ec AS (SELECT ev.id, ev.significance, COALESCE(under, d.country_id, named, CASE WHEN location IS NULL THEN coast END) AS country_id,
  CASE WHEN under IS NOT NULL THEN 'under' WHEN d.country_id IS NOT NULL THEN 'stated' WHEN named IS NOT NULL THEN 'named' WHEN location IS NULL AND coast IS NOT NULL THEN 'coast' END AS found
  FROM ev LEFT JOIN un USING (id) LEFT JOIN country_dim d ON ev.country_iso3 = d.country_id LEFT JOIN nd USING (id) LEFT JOIN co USING (id))"""


@query("event_country", f"WITH {EVENT_COUNTRY} SELECT id, country_id, found FROM ec")
def event_country(v):
    return op.event_country(located(v), v.country_edge, v.country_dim).select("id", "country_id", "found")


@query("country_headlines", f"""WITH {EVENT_COUNTRY}, dg AS (SELECT e AS id, COUNT(*) AS links FROM (SELECT source_id AS e FROM ev_link WHERE confidence >= 0.9 UNION ALL SELECT target_id FROM ev_link WHERE confidence >= 0.9 AND target_id <> source_id) GROUP BY e)
  SELECT id, country_id, significance, COALESCE(links, 0) AS links FROM ec LEFT JOIN dg USING (id) WHERE country_id IN ('CCC','AAA','GGG')""")
def country_headlines(v):
    where = op.event_country(located(v), v.country_edge, v.country_dim).select("id", "country_id", "significance")
    picks = v.country_dim.filter(F.col("country_id").isin("CCC", "AAA", "GGG")).select("country_id", F.col("position").alias("pick"))
    return op.country_headlines(where, picks, graph.link_degree(v.ev_link.filter("confidence >= 0.9")))


# Nations as the cells of a 5 × 5 grid of 36° × 18°, each side cut in two, ring order counter-clockwise.
NATION_EDGES = """
  SELECT 'N' || CAST(n_nationkey AS STRING) AS country_id, 0 AS part, 0 AS ring, k AS seq,
    CAST((n_nationkey%5)*72 - 180 + sx*36 AS DOUBLE) AS x1, CAST(FLOOR(n_nationkey/5)*36 - 90 + sy*18 AS DOUBLE) AS y1,
    CAST((n_nationkey%5)*72 - 180 + ex*36 AS DOUBLE) AS x2, CAST(FLOOR(n_nationkey/5)*36 - 90 + ey*18 AS DOUBLE) AS y2
  FROM nation CROSS JOIN (VALUES (0,0,0,1,0),(1,1,0,2,0),(2,2,0,2,1),(3,2,1,2,2),(4,2,2,1,2),(5,1,2,0,2),(6,0,2,0,1),(7,0,1,0,0)) AS sides(k, sx, sy, ex, ey)"""
_REAL = f"""ne AS ({NATION_EDGES}), re AS (SELECT *, LEAST(printf('%.6f,%.6f', x1, y1), printf('%.6f,%.6f', x2, y2)) || '|' || GREATEST(printf('%.6f,%.6f', x1, y1), printf('%.6f,%.6f', x2, y2)) AS edge FROM ne
   WHERE NOT ((abs(abs(x1)-180) < 0.00001 AND abs(abs(x2)-180) < 0.00001) OR abs(y1) > 89.99999 OR abs(y2) > 89.99999)),
  nb AS (SELECT a.country_id, a.seq, MIN(b.country_id) AS neighbour FROM re a LEFT JOIN re b ON a.edge = b.edge AND a.country_id <> b.country_id GROUP BY ALL)"""


def nation_edges(v):
    return v.spark.sql(NATION_EDGES.replace("FROM nation ", "FROM {nation} "), nation=v.nation)


@query("country_neighbours", f"WITH {_REAL} SELECT country_id, neighbour, COUNT(*) AS shared FROM nb WHERE neighbour IS NOT NULL GROUP BY ALL")
def country_neighbours(v):
    return op.country_neighbours(nation_edges(v))


@query("border_runs", f"""WITH {_REAL}, br AS (SELECT *, SUM(CASE WHEN neighbour IS DISTINCT FROM LAG(neighbour) OVER w OR seq - LAG(seq) OVER w > 1 OR LAG(seq) OVER w IS NULL THEN 1 ELSE 0 END) OVER w AS run FROM nb WINDOW w AS (PARTITION BY country_id ORDER BY seq))
  SELECT country_id, CAST(run AS BIGINT) AS run, neighbour, MIN(seq) AS from_seq, MAX(seq) AS to_seq, COUNT(*) AS edges FROM br GROUP BY ALL""".replace("SUM(CASE WHEN neighbour IS DISTINCT FROM LAG(neighbour) OVER w OR seq - LAG(seq) OVER w > 1 OR LAG(seq) OVER w IS NULL THEN 1 ELSE 0 END) OVER w AS run FROM nb WINDOW w AS (PARTITION BY country_id ORDER BY seq))",
   "SUM(brk) OVER (PARTITION BY country_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN neighbour IS DISTINCT FROM LAG(neighbour) OVER w OR seq - LAG(seq) OVER w > 1 OR LAG(seq) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM nb WINDOW w AS (PARTITION BY country_id ORDER BY seq)))"))
def border_runs(v):
    return op.border_runs(nation_edges(v)).select("country_id", F.col("run").cast("bigint").alias("run"), "neighbour", "from_seq", "to_seq", "edges")


@query("country_centroid", f"WITH ne AS ({NATION_EDGES}) SELECT country_id, (MIN(y1)+MAX(y1))/2 AS lat, (MIN(x1)+MAX(x1))/2 AS lng FROM ne GROUP BY country_id")
def country_centroid(v):
    return op.country_centroid(nation_edges(v))


@query("zonal_mean", f"""WITH px AS (SELECT cell_id, lat, lng AS x, cell_id*7%256 AS r, cell_id*13%256 AS g, cell_id*29%256 AS b FROM pop_cell),
  pt AS (SELECT px.*, cell_id AS id FROM px), inn AS (SELECT DISTINCT id, country_id FROM ({_CONTAINS})),
  j AS (SELECT country_id, r, g, b, NOT (b > r+25 AND b > g+25 AND r+g+b < 260) AS land FROM pt JOIN inn USING (id))
  SELECT d.country_id, CAST(round_even(COALESCE(AVG(r) FILTER (land), AVG(r)), 0) AS BIGINT) AS r, CAST(round_even(COALESCE(AVG(g) FILTER (land), AVG(g)), 0) AS BIGINT) AS g,
   CAST(round_even(COALESCE(AVG(b) FILTER (land), AVG(b)), 0) AS BIGINT) AS b, COUNT(*) FILTER (land) AS land_pixels FROM country_dim d JOIN j USING (country_id) GROUP BY d.country_id""")
def zonal_mean(v):
    key = F.col("cell_id")
    pixels = v.pop_cell.select("lat", "lng", (key * 7 % 256).alias("r"), (key * 13 % 256).alias("g"), (key * 29 % 256).alias("b"))
    means = op.zonal_mean(pixels, v.country_edge, v.country_dim).filter("r is not null")
    return means.select("country_id", *[F.col(c).cast("bigint").alias(c) for c in ("r", "g", "b")], "land_pixels")
