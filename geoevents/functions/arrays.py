"""Column expressions on arrays, term lists and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Chip kinds by term type and their display order.
CHIP_KIND = {"person": "person", "organization": "organization", "org": "organization", "location": "place", "place": "place", "actor": "actor"}
CHIP_ORDER = ["person", "organization", "actor", "place", "topic"]


def term(text: Column, kind: str, confidence: float) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("type"), F.lit(None).cast("double").alias("relevance"),
                    F.lit(float(confidence)).alias("confidence"))


def term_list(*pairs: tuple[Column, str, float]) -> Column:
    """Terms for the texts that are not blank."""
    return F.array_compact(F.array(*[F.when(X.blank_to_null(t).isNotNull(), term(F.trim(t), kind, conf)) for t, kind, conf in pairs]))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where the body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def first_by(items: Column, key) -> Column:
    """Items in order, keeping the first for each key and none with a blank key: those whose key first stands where they stand."""
    def once(all_items: Column) -> Column:
        first = lambda keys: F.filter(all_items, lambda x, i: (F.coalesce(key(x), F.lit("")) != "") & (F.array_position(keys, key(x)) == i + 1))
        return bind(F.transform(all_items, key), first)

    return bind(items, once)


def merge_links(first: Column, second: Column) -> Column:
    """Union of two link lists, first per URL."""
    return first_by(F.concat(first, second), lambda link: link["url"])


def ordered_tags(keywords: Column, impacts: Column) -> Column:
    """Trimmed tags as struct(tag, kind); the first of equal texts wins."""
    as_tag = lambda kind: lambda t: F.struct(F.trim(t).alias("tag"), F.lit(kind).alias("kind"))
    tags = F.concat(F.transform(F.array_compact(keywords), as_tag("keyword")), F.transform(F.array_compact(impacts), as_tag("impact")))
    return first_by(tags, lambda t: t["tag"])


def chips(entities: Column, keywords: Column, place: Column, limit: int = 10) -> Column:
    """People, organisations, actors, places and topics of an event, best first, once each."""
    literal_map = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    kinds = literal_map(CHIP_KIND.items())
    ranks = literal_map((name, CHIP_ORDER.index(kind)) for name, kind in CHIP_KIND.items())

    def classify(t: Column, pos: Column) -> Column:
        weight = F.coalesce(t["relevance"], t["confidence"], F.lit(0.0))
        rank = F.coalesce(F.try_element_at(ranks, t["type"]), F.lit(CHIP_ORDER.index("topic")))
        return F.struct(rank.alias("rank"), (-weight).alias("neg"), pos.alias("pos"), F.trim(t["text"]).alias("text"), F.lower(F.trim(t["text"])).alias("low"),
                        F.coalesce(F.try_element_at(kinds, t["type"]), F.lit("topic")).alias("kind"))

    terms = F.transform(F.concat(entities, keywords), classify)
    usable = bind(F.lower(place), lambda p: F.filter(terms, lambda t: (t["low"] != "") & ~t["low"].eqNullSafe(p)))
    # Struct order is rank, weight, position: the order of a stable sort.
    once = first_by(F.array_sort(usable), lambda t: t["low"])
    show = lambda t: F.struct(F.when(t["kind"] == "actor", X.title_case(t["text"])).otherwise(t["text"]).alias("text"), t["kind"].alias("kind"))
    return F.transform(F.slice(once, 1, limit), show)


def place_label(place: Column, country: Column, location: Column, keywords: Column) -> Column:
    named = F.try_element_at(F.filter(keywords, lambda k: k["type"].isin("location", "place")), F.lit(1))["text"]
    return F.coalesce(*map(X.blank_to_null, (place, country, location)), named)


def _vital(condition: Column, value: Column, label: Column | str, tone: Column | None = None) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    tone = F.lit(None).cast("string") if tone is None else tone
    return F.when(condition, F.struct(value.alias("value"), label.alias("label"), tone.alias("tone")))


def plain_number(value: Column, digits: int = 0) -> Column:
    """Grouped thousands, at most ``digits`` decimals."""
    shown = F.format_number(F.round(value.cast("double"), digits), digits)
    return F.regexp_replace(shown, r"\.0+$", "") if digits else shown


def vital_signs(layer: Column, source: Column, a: Column) -> Column:
    """Up to three figures of an event from its detail struct ``a``."""
    level = F.lower(F.trim(F.coalesce(a["alert"], a["alert_level"])))
    alert = _vital(level.isin("green", "orange", "red"), X.title_case(level), "alert", level)
    own_level = F.lower(F.trim(a["alert_level"]))
    own_alert = _vital(own_level.isin("green", "orange", "red"), X.title_case(own_level), "alert", own_level)
    has = lambda name: a[name].isNotNull()
    says = lambda name: X.blank_to_null(a[name]).isNotNull()
    with_unit = lambda name, unit: F.concat(plain_number(a[name]), F.lit(unit))
    quake = [
        _vital(has("magnitude"), F.concat(F.lit("M "), plain_number(a["magnitude"], 1)),
               F.when(says("mag_type"), F.concat(F.lit("magnitude ("), a["mag_type"], F.lit(")"))).otherwise(F.lit("magnitude"))),
        _vital(has("depth_km"), with_unit("depth_km", " km"), "depth"), alert,
        _vital(a["tsunami"], F.lit("Possible"), "tsunami", F.lit("orange")),
        _vital(a["felt"] != 0, plain_number(a["felt"]), "felt reports"),
    ]
    storm = [_vital(has("max_wind_kmh"), with_unit("max_wind_kmh", " km/h"), "max wind"), own_alert]
    hotspots = [
        _vital(has("max_frp"), with_unit("max_frp", " MW"), "peak fire power"),
        _vital(has("hotspot_count"), plain_number(a["hotspot_count"]), F.when(a["hotspot_count"] == 1, F.lit("hotspot")).otherwise(F.lit("hotspots"))),
        _vital(says("daynight"), F.when(F.trim(a["daynight"]) == "N", F.lit("Night")).otherwise(F.lit("Day")), "detected"),
    ]
    fire = [_vital(has("burned_area_ha"), with_unit("burned_area_ha", " ha"), "burned area"), own_alert]
    flood = [own_alert, _vital(says("country"), F.trim(a["country"]), "country")]
    actors = [
        _vital(says("actor1"), X.title_case(F.trim(a["actor1"])), F.when(says("actor2"), F.lit("side A")).otherwise(F.lit("actor"))),
        _vital(says("actor2"), X.title_case(F.trim(a["actor2"])), "side B"),
        _vital(says("location"), F.trim(a["location"]), "location"),
    ]
    first3 = lambda parts: F.slice(F.array_compact(F.array(*parts)), 1, 3)
    return (F.when(layer == "earthquake", first3(quake)).when(layer == "cyclone", first3(storm))
            .when((layer == "wildfire") & (source == "firms"), first3(hotspots)).when(layer == "wildfire", first3(fire))
            .when(layer == "flood", first3(flood)).otherwise(first3(actors)))


def iso3(value: Column) -> Column:
    """Country code from text that may be a code, a JSON list or a JSON object holding one."""
    text = F.trim(value)
    first = F.when(F.startswith(text, F.lit("[")), F.coalesce(F.get_json_object(text, "$[0].iso3"), F.get_json_object(text, "$[0]")))
    inner = F.when(F.startswith(text, F.lit("{")), F.get_json_object(text, "$.iso3"))
    plain = F.when(~F.rlike(text, F.lit(r"^[\[{]")), text)
    return F.nullif(F.substring(F.upper(F.trim(F.coalesce(first, inner, plain))), 1, 3), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, element by element."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """Vector scaled to length 1; null for a zero vector. The vector and its length are worked out once."""
    scaled = lambda u: lambda length: F.when(length > 1e-12, F.transform(u, lambda x: x.cast("double") / length))
    return bind(v, lambda u: bind(F.sqrt(dot(u, u)), scaled(u)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
