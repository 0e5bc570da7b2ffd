"""Event-shaped views over the given tables, stated once in SQL that Spark and DuckDB both run.

The given tables carry no coordinates, layers or profiles, so these views derive them from keys by fixed
arithmetic. They only rename and derive columns; the operators under test live elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INTERESTS, LAYER_CATEGORY, LAYERS
from ..session import prepare, widened

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
#: Tables whose rows cost much work.
WIDE = {"events", "documents", "pages"}
AS_OF = "2024-01-31 00:00:00"
SOURCES = ["usgs", "gdacs", "firms", "gnews", "wikifeeds", "conflict_csv", "rss"]
WORDS = ["football", "election", "earthquake", "flood", "market", "school", "museum", "strike", "refugee", "vaccine", "software",
         "summit", "wildfire", "storm", "travel", "police", "research", "music", "tennis", "europe", "china", "brazil", "harbour", "bridge"]
PLACES = ["Alder Bay", "Birch Point", "Cedar Falls", "Dune Coast", "Elm Heights", "Fern Valley", "Granite Pass", "Hazel Creek",
          "Iris Lake", "Juniper Town", "Kelp Island", "Laurel City"]
# Test countries: (id, name, [rings of boxes as (west, south, east, north)]); the first ring is the outline, others are holes.
COUNTRIES = [
    ("AAA", "Aland", [[(-170.0, 10.0, -60.0, 60.0), (-120.0, 30.0, -100.0, 45.0)]]),
    ("BBB", "Borland", [[(-80.0, -55.0, -35.0, 10.0)]]),
    ("CCC", "Cadia", [[(-12.0, 36.0, 40.0, 60.0)]]),
    ("DDD", "Dorado", [[(-15.0, -34.0, 35.0, 36.0), (5.0, -10.0, 20.0, 5.0)]]),
    ("EEE", "Estora", [[(40.0, 5.0, 100.0, 60.0)]]),
    ("FFF", "Fidalia", [[(170.0, -45.0, 180.0, -20.0)], [(-180.0, -45.0, -172.0, -20.0)]]),
    ("GGG", "Gondor", [[(110.0, -45.0, 155.0, -10.0)]]),
    ("HHH", "Havnia", [[(100.0, 5.0, 145.0, 50.0)]]),
]
ALIAS_PLACES = ["Aland", "Borland", "Cadia", "Dorado", "Estora", "Fidalia", "Gondor", "Havnia"]


def _pick(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {whens} END"


def _lng(cluster: str, key: str) -> str:
    return f"CAST(({cluster}*7919)%340 AS DOUBLE) - 170 + CAST(({key}*31)%400 AS DOUBLE)/100 - 2"


def _lat(cluster: str, key: str) -> str:
    return f"CAST(({cluster}*104729)%120 AS DOUBLE) - 60 + CAST((({key}%400)*({key}%400)+17*({key}%400))%400 AS DOUBLE)/100 - 2"


def _values(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns})"


def _country_edges() -> list[str]:
    rows = []
    for code, _name, parts in COUNTRIES:
        for part, rings in enumerate(parts):
            for ring, (w, s, e, n) in enumerate(rings):
                corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
                for seq, ((ax, ay), (bx, by)) in enumerate(zip(corners, corners[1:])):
                    rows.append(f"('{code}', {part}, {ring}, {seq}, CAST({ax} AS DOUBLE), CAST({ay} AS DOUBLE), CAST({bx} AS DOUBLE), CAST({by} AS DOUBLE))")
    return rows


VIEWS: dict[str, str] = {
    "ev": f"""
      SELECT event_id, 'ev:' || CAST(event_id AS STRING) AS id, ts AS occurred_at, <US:ts> AS t_us, user_id, event_type, value, props,
        CAST(LEAST(value, CAST(100 AS DOUBLE)) AS DOUBLE) AS significance,
        {_pick('user_id*13+event_id*7', LAYERS)} AS layer_id,
        {_pick('event_id', SOURCES)} AS source,
        {_lng('user_id', 'event_id')} AS lng, {_lat('user_id', 'event_id')} AS lat,
        {_pick('event_id*17+user_id', WORDS)} || ' ' || {_pick('event_id*29+7', WORDS)} || ' near ' || {_pick('event_id*5+user_id', PLACES)} AS title,
        CASE WHEN event_id % 5 = 0 THEN {_pick('user_id', [c[0] for c in COUNTRIES])} END AS country_iso3,
        CASE WHEN event_id % 4 = 1 THEN 'Old Port (harbour), ' || {_pick('event_id+user_id', ALIAS_PLACES + ['Nowhere', 'Open Sea'])} END AS location,
        CASE event_id % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'orange' WHEN 2 THEN 'Green' WHEN 4 THEN 'none' END AS alert_level,
        CASE WHEN event_id % 3 <> 0 THEN 'https://img.example/' || CAST(event_id AS STRING) END AS image_url,
        CASE WHEN event_id % 11 = 5 THEN 'ev:' || CAST(event_id - 1 AS STRING) END AS canonical_id,
        value / 60 AS magnitude
      FROM events""",
    "news": f"""
      SELECT doc_id, 'doc:' || CAST(doc_id AS STRING) AS id, source AS publisher_id, lang, text,
        CASE WHEN regexp_extract(text, '^([^.!?]+[.!?])', 1) <> '' THEN TRIM(regexp_extract(text, '^([^.!?]+[.!?])', 1)) ELSE SUBSTRING(text, 1, 120) END AS title,
        {_pick('doc_id*7', LAYERS)} AS category,
        CASE WHEN doc_id % 2 = 0 THEN 'gnews' ELSE 'wikifeeds' END AS source,
        <TS>'2024-01-01 00:00:00' + INTERVAL '1' MINUTE * ((doc_id*7919) % 43200) AS occurred_at,
        1704067200000000 + ((doc_id*7919) % 43200) * 60000000 AS t_us,
        {_lng('((doc_id*31)%150)', 'doc_id')} AS lng, {_lat('((doc_id*31)%150)', 'doc_id')} AS lat,
        CAST((doc_id*37)%101 AS DOUBLE) AS significance
      FROM documents""",
    "ev_link": """
      SELECT 'link:' || CAST(event_id AS STRING) AS link_id, 'ev:' || CAST(event_id AS STRING) AS source_id,
        'ev:' || CAST(ABS(event_id - (event_id*7+user_id)%23) AS STRING) AS target_id,
        CASE event_id % 6 WHEN 0 THEN 'same-event' WHEN 1 THEN 'SHARES_CONTEXT' WHEN 2 THEN 'mentions' WHEN 3 THEN 'PRIMARY_STORY' WHEN 4 THEN 'co_occurs' ELSE 'weird' END AS relation,
        CAST((event_id*53)%101 AS DOUBLE)/100 AS confidence,
        ts AS created_at, event_id AS seq
      FROM events""",
    "actions": f"""
      SELECT user_id, event_id AS seq, 'ev:' || CAST(user_id*6 + event_id%6 AS STRING) AS event_id,
        CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'source' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'more' ELSE 'less' END AS kind,
        CASE event_id % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'explore' ELSE 'headlines' END AS view,
        ts AS acted_at, <US:ts> AS t_us
      FROM events""",
    "user_interest": " UNION ".join(
        f"SELECT user_id, {_pick(f'user_id*7+{j * 11}', [i[0] for i in INTERESTS])} AS interest_id FROM events" for j in range(3)),
    "pop_cell": f"""
      SELECT c_custkey AS cell_id, c_acctbal * 100 AS pop, {_lng('(c_custkey%150)', '(c_custkey*7)')} AS lng, {_lat('(c_custkey%150)', '(c_custkey*11)')} AS lat
      FROM customer""",
    "publisher": """
      SELECT 'src' || CAST(n_nationkey AS STRING) AS publisher_id, n_name AS name, r_name AS country,
        CASE WHEN n_nationkey % 6 = 4 THEN 'pending' ELSE 'approved' END AS status
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "feed": """
      SELECT 'https://feeds.example/' || CAST(s_suppkey AS STRING) AS feed_url, 'src' || CAST(s_suppkey % 25 AS STRING) AS publisher_id,
        s_suppkey AS feed_key, s_suppkey % 7 AS error_count, 30 + 15 * (s_suppkey % 4) AS poll_minutes,
        CASE WHEN s_suppkey % 9 <> 0 THEN <TS>'2024-01-31 00:00:00' - INTERVAL '1' MINUTE * ((s_suppkey*13) % 120) END AS last_fetched_at
      FROM supplier""",
    "feed_item": """
      SELECT 'item:' || CAST(doc_id AS STRING) AS item_id, doc_id, source AS publisher_id, lang AS country, text,
        CASE WHEN doc_id % 13 <> 0 THEN <TS>'2024-01-28 00:00:00' + INTERVAL '1' MINUTE * ((doc_id*7919) % 5000) END AS published_at
      FROM documents""",
    "country_edge": _values(_country_edges(), "country_id, part, ring, seq, x1, y1, x2, y2"),
    "country_dim": _values([f"('{c}', '{n}', {i})" for i, (c, n, _) in enumerate(COUNTRIES)], "country_id, name, position"),
    "layer_category": _values([f"('{layer}', '{cat}')" for layer, cat in LAYER_CATEGORY.items()], "layer_id, category"),
    "vectors": "SELECT 'ev:' || CAST(vec_id AS STRING) AS key, vec_id, embedding, label FROM embeddings",
}


def _render(text: str, duck: bool) -> str:
    text = text.replace("<TS>", "TIMESTAMP " if duck else "TIMESTAMP_NTZ ")
    return re.sub(r"<US:(\w+)>", r"epoch_us(\1)" if duck else r"unix_micros(CAST(\1 AS TIMESTAMP))", text)


def _uses(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def with_views(sql: str) -> str:
    """The oracle query with the views it names put in front as CTEs."""
    names = [n for n in _uses(sql, VIEWS) if re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", sql, re.I)]
    ctes = ", ".join(f"{n} AS ({_render(VIEWS[n], True)})" for n in names)
    if not ctes:
        return sql
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[recursive.end():]}"
    if plain:
        return f"WITH {ctes}, {body[plain.end():]}"
    return f"WITH {ctes} {body}"


class Views:
    """The given tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return widened(table) if name in WIDE else table

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = _render(VIEWS[name], False)
            tables = _uses(text, TABLES)
            for t in tables:
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            return self.spark.sql(text, **{t: self.table(t) for t in tables})
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @property
    def text_news(self) -> DataFrame:
        """News with keywords: the distinct long words of the whole text."""
        long_words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: F.char_length(w) >= 8)
        return self.news.withColumn("keywords", F.array_distinct(long_words))
