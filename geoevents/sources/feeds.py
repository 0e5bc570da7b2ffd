"""Raw feeds to events: readers with explicit schemas, and the projections that normalise their rows.

Each ``*_events`` function takes raw rows and is a plain projection; rows that cannot be placed or dated are dropped.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrays as Y
from ..functions import score as M
from ..functions import text as X
from ..functions import times as C
from ..operators.filters import junk_reason, window_verdict

c = F.col

# Alert feed codes, news categories and conflict categories.
ALERT_KINDS = {"EQ": "earthquake", "TC": "cyclone", "FL": "flood", "VO": "volcano", "DR": "drought", "WF": "wildfire"}
NEWS_LAYERS = {"general": "news", "world": "world", "nation": "politics", "business": "business", "technology": "technology",
               "entertainment": "entertainment", "sports": "sports", "science": "science", "health": "health"}
CONFLICT_TYPES = ["Battles", "Explosions/Remote violence", "Violence against civilians", "Riots"]
CODED_CATEGORIES = ["conflict", "protest", "terror", "politics", "crime"]
CONFLICT_TEXTS = ["disorder_type", "civilian_targeting", "actor1", "assoc_actor_1", "actor2", "assoc_actor_2", "inter1", "inter2", "interaction",
                  "location", "admin1", "admin2", "admin3", "region", "country", "source_scale"]

QUAKE_SCHEMA = """features ARRAY<STRUCT<id: STRING, properties: STRUCT<mag: DOUBLE, place: STRING, time: BIGINT, updated: BIGINT, url: STRING, title: STRING,
  type: STRING, sig: DOUBLE, tsunami: INT, felt: DOUBLE, cdi: DOUBLE, mmi: DOUBLE, alert: STRING, status: STRING, magType: STRING, code: STRING>,
  geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>"""
# Fields that come as text, list or object are read as text.
ALERT_SCHEMA = """features ARRAY<STRUCT<properties: STRUCT<eventtype: STRING, eventid: BIGINT, episodeid: BIGINT, name: STRING, htmldescription: STRING,
  alertlevel: STRING, alertscore: STRING, fromdate: STRING, todate: STRING, iso3: STRING, url: STRING, link: STRING, severitydata: STRING, population: STRING,
  affectedpopulation: STRING, glide: STRING, country: STRING, longitude: STRING, lon: STRING, latitude: STRING, lat: STRING>,
  geometry: STRUCT<type: STRING, coordinates: STRING>>>"""
HOTSPOT_SCHEMA = "latitude STRING, longitude STRING, bright_ti4 STRING, brightness STRING, acq_date STRING, acq_time STRING, satellite STRING, confidence STRING, frp STRING, daynight STRING"
CONFLICT_SCHEMA = "data ARRAY<STRUCT<" + ", ".join(f"{n}: STRING" for n in [
    "event_id_cnty", "event_date", "time_precision", "event_type", "sub_event_type", "geo_precision", "latitude", "longitude", "fatalities", "notes", "tags", "iso", "source", "population_best", "timestamp",
    *CONFLICT_TEXTS]) + ">>"
CODED_SCHEMA = ", ".join(f"{n} STRING" for n in [
    "SQLDATE", "Actor1Name", "Actor2Name", "EventCode", "ActionGeo_FullName", "ActionGeo_Lat", "ActionGeo_Long", "GoldsteinScale", "NumArticles", "SOURCEURL", "title", "description", "category"])
NEWS_SCHEMA = "title STRING, description STRING, url STRING, image STRING, publishedAt STRING, source STRUCT<name: STRING>, _layerId STRING"
STORY_SCHEMA = """news ARRAY<STRUCT<story: STRING, text: STRING, links: ARRAY<STRUCT<title: STRING, titles: STRUCT<normalized: STRING>, thumbnail: STRUCT<source: STRING>, content_urls: STRUCT<desktop: STRUCT<page: STRING>>>>>>,
  onthisday ARRAY<STRUCT<text: STRING, story: STRING, pages: ARRAY<STRUCT<title: STRING, titles: STRUCT<normalized: STRING>, thumbnail: STRUCT<source: STRING>, content_urls: STRUCT<desktop: STRUCT<page: STRING>>>>>>"""


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per feature of GeoJSON collections (one document per file)."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))


def first_with_features(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, str]:
    """Features of the first of several feeds that has any, and its path; the last one where none has."""
    for path in paths:
        found = read_features(spark, path, schema)
        if not found.isEmpty():
            break
    return found, path


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files): the first line with text of every file, and the files that share it."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").filter("file_block_start = 0 AND trim(value) <> ''")
    # A file's first block is read by one task in order.
    first = lines.withColumn("line", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    return first.groupBy("header").agg(F.collect_list("file_path").alias("files"))


def read_rows(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """CSV files with headers, all columns as text. In each file columns are found by name; others are left out, missing ones are null.

    Files are read together if their headers are equal. A name that a header has twice means its last column. Quotes inside quotes are doubled.
    """
    wanted = StructType.fromDDL(schema).fields
    out = None
    # One row per different header; the driver lists the files anyway.
    for row in headers(spark, path).orderBy("header").collect():
        names = [n.strip().removeprefix("\ufeff") for n in next(csv.reader([row["header"]]))]
        place = {n: f"c{k}" for k, n in enumerate(names)}
        reader = spark.read.schema(", ".join(f"c{k} STRING" for k in range(len(names)))).option("header", True).option("escape", '"').option("multiLine", multiline)
        found = reader.csv([unquote(f) for f in row["files"]])
        part = found.select(*(F.col(place[f.name]).cast(f.dataType).alias(f.name) if f.name in place else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], StructType(wanted)) if out is None else out


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of conflict answers (JSON documents with a list ``data``), all fields as text."""
    return spark.read.schema(CONFLICT_SCHEMA).option("multiLine", True).json(path).select(F.inline("data"))


def read_coded(spark: SparkSession, path: str) -> DataFrame:
    """Rows of coded conflict CSV files; texts may hold line breaks."""
    return read_rows(spark, path, CODED_SCHEMA, multiline=True)


def event_columns(**given: Column) -> list[Column]:
    """All event columns in order; what a feed does not give has the default of the table."""
    text = lambda: F.lit(None).cast("string")
    defaults = {
        "event_id": text(), "source": text(), "source_event_id": text(), "category": text(), "subtype": text(), "title": text(), "summary": text(), "info_url": text(),
        "occurred_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp"), "ended_at": F.lit(None).cast("timestamp"),
        "lng": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "alt_m": F.lit(None).cast("double"), "geo_precision": F.lit("point"), "geo_source": F.lit("native"),
        "significance": F.lit(0.0), "weight": F.lit(None).cast("double"), "country_iso3": text(), "entities": F.array().cast("array<struct<text:string,type:string,relevance:double,confidence:double>>"),
    }
    extra = {k: v for k, v in given.items() if k not in defaults}
    return [given.get(k, v).alias(k) for k, v in defaults.items()] + [v.alias(k) for k, v in extra.items()]


def quake_events(features: DataFrame) -> DataFrame:
    """Earthquake features with their detail struct and whether a tsunami is flagged."""
    p, coords = c("properties"), c("geometry.coordinates")
    lng, lat, depth = (F.get(coords, i) for i in range(3))
    key = F.coalesce(c("id"), p["code"])
    detail = F.struct(p["mag"].alias("magnitude"), p["magType"].alias("mag_type"), depth.alias("depth_km"), (F.coalesce(p["tsunami"], F.lit(0)) != 0).alias("tsunami"),
                      p["felt"].cast("int").alias("felt"), p["cdi"].alias("cdi"), p["mmi"].alias("mmi"), p["sig"].cast("int").alias("sig"), p["alert"].alias("alert"),
                      p["status"].alias("status"), p["place"].alias("place"))
    usable = lng.isNotNull() & lat.isNotNull() & (F.coalesce(key, F.lit("")) != "")
    return features.filter(usable).select(*event_columns(
        event_id=F.concat(F.lit("usgs:"), key), source=F.lit("usgs"), source_event_id=key, category=F.lit("earthquake"),
        subtype=F.coalesce(X.blank_to_null(p["type"]), F.lit("earthquake")), title=F.coalesce(X.blank_to_null(p["title"]), F.concat(F.lit("M "), p["mag"].cast("string"))),
        summary=p["place"], info_url=p["url"], occurred_at=C.epoch_ms(p["time"]), updated_at=C.epoch_ms(p["updated"]), lng=lng, lat=lat, alt_m=-depth * 1000.0,
        significance=F.coalesce(p["sig"], F.coalesce(p["mag"], F.lit(0.0)) * 10.0), weight=p["mag"], entities=Y.term_list((p["place"], "place", 0.9)), detail=detail))


def alert_events(features: DataFrame, as_of: Column) -> DataFrame:
    """Alert features of all hazard kinds with the measure their unit makes of the severity."""
    p = c("properties")
    kinds = F.create_map(*[F.lit(x) for pair in ALERT_KINDS.items() for x in pair])
    code = F.upper(F.coalesce(p["eventtype"], F.lit("")))
    category = F.try_element_at(kinds, code)
    point = F.from_json(c("geometry.coordinates"), "ARRAY<DOUBLE>")
    is_point = (c("geometry.type") == "Point") & (F.size(point) >= 2)
    first = lambda *names: M.num(F.coalesce(*[X.blank_to_null(p[n]) for n in names]))
    lng = F.when(is_point, F.get(point, 0)).otherwise(first("longitude", "lon"))
    lat = F.when(is_point, F.get(point, 1)).otherwise(first("latitude", "lat"))
    key = F.concat_ws(":", code, p["eventid"].cast("string"), F.coalesce(p["episodeid"], F.lit(0)).cast("string"))
    severity = F.get_json_object(p["severitydata"], "$.severity").try_cast("double")
    unit = F.coalesce(F.get_json_object(p["severitydata"], "$.severityunit"), F.lit(""))
    said = F.get_json_object(p["severitydata"], "$.severitytext")
    link = F.coalesce(X.blank_to_null(p["url"]), p["link"])
    url = F.when(F.startswith(link, F.lit("{")), F.coalesce(*[X.blank_to_null(F.get_json_object(link, f"$.{k}")) for k in ("report", "details", "geometry")])).otherwise(link)
    score = M.num(p["alertscore"])
    measure = M.kind_measure(category, severity, unit)
    detail = F.struct(p["eventid"].alias("gdacs_event_id"), p["episodeid"].alias("episode_id"), p["alertlevel"].alias("alert_level"), score.alias("alert_score"),
                      M.whole(F.coalesce(X.blank_to_null(p["population"]), p["affectedpopulation"])).alias("population"), p["glide"].alias("glide"), p["name"].alias("name"), said.alias("severity_text"),
                      p["country"].alias("country"), Y.iso3(p["iso3"]).alias("iso3"), *[measure[m].alias(m) for m in ("magnitude", "max_wind_kmh", "flood_severity_score", "affected_area_km2", "burned_area_ha")])
    usable = category.isNotNull() & lng.isNotNull() & lat.isNotNull() & p["eventid"].isNotNull()
    return features.filter(usable).select(*event_columns(
        event_id=F.concat(F.lit("gdacs:"), key), source=F.lit("gdacs"), source_event_id=key, category=category, subtype=code,
        title=F.coalesce(X.blank_to_null(p["name"]), X.blank_to_null(p["htmldescription"]), key), summary=said, info_url=url, occurred_at=F.coalesce(C.parse_iso(p["fromdate"]), as_of),
        updated_at=as_of, ended_at=C.parse_iso(p["todate"]), lng=lng, lat=lat, significance=M.alert_significance(p["alertlevel"], score), weight=F.coalesce(severity, score),
        country_iso3=Y.iso3(p["iso3"]), detail=detail))


def hotspots(rows: DataFrame) -> DataFrame:
    """Fire detections; rows without a position or a readable time are skipped."""
    rows = _filled(rows, ["brightness"])
    lat, lng = M.finite(c("latitude")), M.finite(c("longitude"))
    clock = F.coalesce(c("acq_time"), F.lit("0000"))
    clock = F.when(F.char_length(clock) < 4, F.lpad(clock, 4, "0")).otherwise(clock)
    at = F.try_to_timestamp(F.concat(c("acq_date"), clock), F.lit("yyyy-MM-ddHHmm"))
    key = F.concat_ws(":", F.lit("firms"), F.coalesce(c("satellite"), F.lit("None")), c("acq_date"), clock, F.format_string("%.4f", lat), F.format_string("%.4f", lng))
    return rows.filter(lat.isNotNull() & lng.isNotNull() & at.isNotNull()).select(
        key.alias("hotspot_id"), lat.alias("lat"), lng.alias("lng"), at.alias("acq_at"), "satellite", "confidence", M.num(c("frp")).alias("frp"),
        M.num(F.coalesce(X.blank_to_null(c("bright_ti4")), c("brightness"))).alias("brightness"), "daynight")


def _filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns a feed may lack, as null text."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def conflict_events(rows: DataFrame) -> DataFrame:
    """Coded conflict, protest and strategic events with detail struct and ordered tags."""
    rows = _filled(rows, CONFLICT_TEXTS + ["time_precision", "geo_precision", "iso", "source", "population_best", "timestamp", "tags", "notes", "fatalities", "sub_event_type"])
    kind = F.trim(c("event_type"))
    category = F.when(kind.isin(CONFLICT_TYPES), F.lit("conflict")).when(kind == "Protests", F.lit("protest")).when(kind == "Strategic developments", F.lit("strategic_development"))
    key, lat, lng = F.trim(c("event_id_cnty")), M.num(c("latitude")), M.num(c("longitude"))
    at = F.try_to_timestamp(F.trim(c("event_date")), F.lit("yyyy-MM-dd"))
    fatalities = M.whole(c("fatalities"))
    text = lambda name: X.blank_to_null(c(name))
    detail = F.struct(kind.alias("event_type"), *[F.nullif(c(n), F.lit("")).alias(n) for n in CONFLICT_TEXTS], fatalities.cast("int").alias("fatalities"),
                      M.whole(c("time_precision")).cast("int").alias("time_precision"), M.whole(c("geo_precision")).cast("int").alias("geo_precision_code"), M.whole(c("iso")).cast("int").alias("iso"),
                      F.nullif(c("source"), F.lit("")).alias("source_name"), M.num(c("population_best")).alias("population_best"),
                      F.when(category == "protest", X.crowd_size(F.coalesce(c("tags"), F.lit("")))).alias("crowd_size"))
    impacts = F.array(F.when(fatalities > 0, F.lit("fatalities")), F.when(text("civilian_targeting").isNotNull(), F.lit("civilian_targeting")))
    tags = Y.ordered_tags(F.concat(F.array(kind, c("sub_event_type"), c("disorder_type")), F.split(F.coalesce(c("tags"), F.lit("")), ";")), impacts)
    usable = category.isNotNull() & (F.coalesce(key, F.lit("")) != "") & lat.isNotNull() & lng.isNotNull() & at.isNotNull()
    return rows.filter(usable).select(*event_columns(
        event_id=F.concat(F.lit("acled:"), key), source=F.lit("acled"), source_event_id=key, category=category, subtype=text("sub_event_type"),
        title=X.conflict_title(c("sub_event_type"), kind, c("location"), c("country")), summary=F.nullif(c("notes"), F.lit("")), occurred_at=at,
        updated_at=F.when(M.whole(c("timestamp")) != 0, C.epoch_s(M.whole(c("timestamp")))), lng=lng, lat=lat, geo_precision=M.geo_precision_from_code(c("geo_precision")),
        significance=M.conflict_significance(fatalities, c("civilian_targeting")), weight=F.coalesce(fatalities, F.lit(0)).cast("double"),
        entities=Y.term_list((c("actor1"), "actor", 1.0), (c("actor2"), "actor", 1.0)), detail=detail, tags=tags))


def coded_events(rows: DataFrame) -> DataFrame:
    """Coded news events; only conflicts and protests have a detail struct."""
    text = lambda name: F.trim(F.coalesce(c(name), F.lit("")))
    category, url, place, code = text("category"), text("SOURCEURL"), text("ActionGeo_FullName"), text("EventCode")
    lat, lng = M.num(c("ActionGeo_Lat")), M.num(c("ActionGeo_Long"))
    at = F.try_to_timestamp(text("SQLDATE"), F.lit("yyyyMMdd"))
    detail = F.when(category.isin("conflict", "protest"), F.struct(category.alias("event_type"), X.blank_to_null(c("Actor1Name")).alias("actor1"), X.blank_to_null(c("Actor2Name")).alias("actor2"), F.nullif(place, F.lit("")).alias("location")))
    usable = category.isin(CODED_CATEGORIES) & (url != "") & (text("title") != "") & lat.isNotNull() & lng.isNotNull() & at.isNotNull()
    return rows.filter(usable).select(*event_columns(
        event_id=F.concat(F.lit("conflict-csv:"), url), source=F.lit("conflict_csv"), source_event_id=url, category=category, subtype=F.nullif(code, F.lit("")), title=text("title"),
        summary=X.blank_to_null(c("description")), info_url=url, occurred_at=at, updated_at=at, lng=lng, lat=lat, geo_precision=M.geo_precision_from_place(place),
        significance=M.goldstein_significance(c("GoldsteinScale")), weight=F.coalesce(M.whole(c("NumArticles")), F.lit(0)).cast("double"),
        entities=Y.term_list((c("Actor1Name"), "actor", 1.0), (c("Actor2Name"), "actor", 1.0)), detail=detail, tags=Y.ordered_tags(F.array(category, code), F.array().cast("array<string>"))))


def layer_of_news_category(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in NEWS_LAYERS.items() for x in pair]), category)


def article_events(articles: DataFrame, as_of: Column) -> DataFrame:
    """News articles before enrichment: no coordinates yet."""
    title, url = F.coalesce(c("title"), F.lit("")), F.trim(F.coalesce(c("url"), F.lit("")))
    name = F.coalesce(X.blank_to_null(c("source.name")), F.lit("gnews"))
    link = F.struct(url.alias("url"), name.alias("source"), F.substring(title, 1, 80).alias("label"))
    links = F.when(url != "", F.array(link)).otherwise(F.array().cast("array<struct<url:string,source:string,label:string>>"))
    return articles.select(
        X.short_sha1("gnews", F.when(url != "", url).otherwise(title)).alias("id"), F.lit("gnews").alias("source"), links.alias("links"), X.blank_to_null(c("image")).alias("image_url"),
        F.coalesce(X.blank_to_null(c("_layerId")), F.lit("news")).alias("layer_id"), title.alias("title"), F.nullif(c("description"), F.lit("")).alias("summary"),
        F.coalesce(C.parse_iso(c("publishedAt")), as_of).alias("occurred_at"), F.lit("llm_hint").alias("geo_source"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("significance"))


def story_events(days: DataFrame) -> DataFrame:
    """Stories of a day: current events, else the day's anniversaries. Input: wiki_date and the feed's columns."""
    shape = "array<struct<story:string,links:array<struct<title:string,titles:struct<normalized:string>,thumbnail:struct<source:string>,content_urls:struct<desktop:struct<page:string>>>>>>"
    pick = lambda items, links: F.transform(items, lambda s: F.struct(F.coalesce(X.blank_to_null(s["story"]), s["text"]).alias("story"), s[links].alias("links"))).cast(shape)
    stories = days.select("wiki_date", F.explode(F.when(c("news").isNotNull(), pick(c("news"), "links")).otherwise(pick(c("onthisday"), "pages"))).alias("s"))
    plain = X.squeeze(X.strip_tags(c("s.story")))
    pages = F.coalesce(c("s.links"), F.array().cast(shape[len("array<struct<story:string,links:"):-2]))
    with_url = F.filter(pages, lambda p: F.coalesce(p["content_urls"]["desktop"]["page"], F.lit("")) != "")
    links = F.transform(with_url, lambda p: F.struct(p["content_urls"]["desktop"]["page"].alias("url"), F.lit("wikipedia").alias("source"), F.coalesce(X.blank_to_null(p["titles"]["normalized"]), p["title"]).alias("label")))
    thumbnail = F.try_element_at(F.filter(F.transform(pages, lambda p: p["thumbnail"]["source"]), lambda t: t.isNotNull()), F.lit(1))
    title = X.first_sentence(plain)
    return stories.filter(plain != "").select(X.short_sha1("wikifeeds", title).alias("id"), F.lit("wikifeeds").alias("source"), links.alias("links"), thumbnail.alias("image_url"),
                                              F.lit("news").alias("layer_id"), title.alias("title"), plain.alias("summary"), c("wiki_date").cast("timestamp").alias("occurred_at"))


def feed_items(entries: DataFrame, as_of: Column, hours: int = 48, closed: bool = False) -> DataFrame:
    """Parsed feed entries as items, each with the reason it is dropped for (null: kept). ``closed`` as in ``clean_text``.

    Input: link, title, summary, published_at, media, enclosures, language, feed_url, publisher_id, country.
    """
    title = X.clean_text(c("title"), 400, closed)
    url = X.canonical_url(c("link"))
    staged = entries.withColumns({"clean_title": title, "url": url})
    reason = (F.when((F.coalesce(c("link"), F.lit("")) == "") | (c("clean_title") == ""), F.lit("no link/title"))
              .when(~window_verdict(c("published_at"), as_of, hours), F.lit("outside window")).otherwise(junk_reason(c("clean_title"), c("url"))))
    return staged.select(
        F.sha1("url").alias("item_id"), "feed_url", "publisher_id", "country", "url", c("clean_title").alias("title"), F.nullif(X.clean_text(c("summary"), 600, closed), F.lit("")).alias("summary"),
        X.entry_image(c("media"), c("enclosures"), c("summary")).alias("image_url"), F.nullif(F.lower(F.substring_index("language", "-", 1)), F.lit("")).alias("language"), "published_at", reason.alias("dropped"))


def outlines(texts: DataFrame, column: str = "value") -> DataFrame:
    """(title, feed URL) of every outline in OPML text, well formed or not."""
    tags = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"<outline\b[^>]*>"), F.lit(0))).alias("tag"))
    attr = lambda key: F.regexp_extract("tag", rf'\b{key}="([^"]*)"', 1)
    title = F.when(attr("title") != "", attr("title")).otherwise(attr("text"))
    return tags.filter(attr("xmlUrl") != "").select(X.unescape(title).alias("title"), X.unescape(attr("xmlUrl")).alias("feed_url"))


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    return outlines(spark.read.option("wholetext", True).text(path))


def catalog_stars(lines: DataFrame, column: str = "value") -> DataFrame:
    """Position, brightness and colour from fixed byte columns; entries without position or magnitude are dropped."""
    field = lambda first, last: F.trim(F.substring(column, first, last - first + 1))
    n = lambda first, last: F.coalesce(M.num(field(first, last)), F.lit(0.0))
    ra = 15.0 * (n(76, 77) + n(78, 79) / 60.0 + n(80, 83) / 3600.0)
    dec = F.when(field(84, 84) == "-", -1.0).otherwise(1.0) * (n(85, 86) + n(87, 88) / 60.0 + n(89, 90) / 3600.0)
    usable = (field(76, 77) != "") & (field(103, 107) != "")
    return lines.filter(usable).select(F.round(ra, 2).alias("ra_deg"), F.round(dec, 2).alias("dec_deg"), F.round(n(103, 107), 2).alias("vmag"), F.round(F.coalesce(M.num(field(110, 114)), F.lit(0.6)), 2).alias("bv"))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Gridded population cells; see ``operators.exposure.population_cells`` for what counts as no data."""
    return spark.read.schema("tile_row INT, tile_col INT, lat DOUBLE, lng DOUBLE, pop DOUBLE").parquet(path)
