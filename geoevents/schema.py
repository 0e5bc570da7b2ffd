"""Fixed dimensions and record types of the event model."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category id -> label and its layers, in display order.
CATEGORIES = {
    "security": ("Conflict & Security", ["conflict", "terror", "crime", "protest", "strategic_development"]),
    "politics": ("Politics & World", ["politics", "world", "news", "media"]),
    "economy": ("Economy & Tech", ["finance", "business", "technology", "science"]),
    "society": ("Humanitarian & Health", ["humanitarian", "famine", "health", "education"]),
    "culture": ("Culture & Lifestyle", ["culture", "entertainment", "sports", "fashion", "travel", "food"]),
    "hazards": ("Natural Hazards", ["earthquake", "wildfire", "cyclone", "flood", "volcano", "drought", "environment"]),
}
DEFAULT_CATEGORIES = ["security", "politics", "economy"]
LAYER_CATEGORY = {layer: name for name, (_, layers) in CATEGORIES.items() for layer in layers}
LAYERS = list(LAYER_CATEGORY)

# Singular hazard names shown on cards.
HAZARD_LABELS = {
    "earthquake": "Earthquake", "wildfire": "Wildfire", "cyclone": "Cyclone", "flood": "Flood",
    "volcano": "Volcano", "drought": "Drought", "environment": "Environment",
}
# Categories that own a detail table.
HAZARD_KINDS = ["earthquake", "wildfire", "cyclone", "flood", "drought", "volcano"]
CONFLICT_KINDS = ["conflict", "protest", "strategic_development"]
KINDS = HAZARD_KINDS + CONFLICT_KINDS

# Search radius per hazard, km.
HAZARD_RADIUS_KM = {"earthquake": 50.0, "wildfire": 25.0, "flood": 40.0, "cyclone": 80.0, "volcano": 30.0}

# The interest catalogue (id, group, label, layers, keywords, [south, north, west, east]).
INTERESTS = [
    ("conflict", "security", "War & conflict", ["conflict", "strategic_development"], ["war", "military", "strike", "troops", "conflict", "ceasefire"], None),
    ("protests", "security", "Protests & unrest", ["protest"], ["protest", "demonstration", "rally", "strike"], None),
    ("crime", "security", "Crime & justice", ["crime", "terror"], ["crime", "police", "court", "trial", "terror", "attack"], None),
    ("elections", "politics", "Elections & government", ["politics"], ["election", "vote", "government", "parliament", "president", "minister"], None),
    ("geopolitics", "politics", "Diplomacy & geopolitics", ["world", "politics"], ["diplomacy", "summit", "sanctions", "treaty", "foreign"], None),
    ("media", "politics", "Media & press", ["media", "news"], ["media", "journalist", "press", "broadcaster"], None),
    ("markets", "economy", "Markets & money", ["finance"], ["market", "stocks", "inflation", "interest rate", "bank", "economy"], None),
    ("business", "economy", "Business & companies", ["business"], ["company", "business", "startup", "merger", "earnings"], None),
    ("tech", "economy", "Tech & AI", ["technology"], ["technology", "ai", "artificial intelligence", "software", "chip", "cyber"], None),
    ("science", "economy", "Science & space", ["science"], ["science", "research", "space", "nasa", "discovery"], None),
    ("health", "society", "Health", ["health"], ["health", "disease", "outbreak", "vaccine", "hospital"], None),
    ("humanitarian", "society", "Humanitarian & migration", ["humanitarian", "famine"], ["refugee", "migrant", "aid", "famine", "humanitarian"], None),
    ("education", "society", "Education", ["education"], ["school", "university", "education", "students"], None),
    ("football", "culture", "Football", ["sports"], ["football", "soccer", "premier league", "champions league", "goal"], None),
    ("sports", "culture", "Other sports", ["sports"], ["rugby", "tennis", "basketball", "olympics", "cricket", "f1"], None),
    ("film", "culture", "Film, TV & music", ["entertainment"], ["film", "movie", "tv", "music", "celebrity", "album"], None),
    ("arts", "culture", "Arts & culture", ["culture", "fashion"], ["art", "museum", "culture", "fashion", "book"], None),
    ("travel", "culture", "Food & travel", ["travel", "food"], ["travel", "tourism", "food", "restaurant"], None),
    ("europe", "region", "Europe", [], ["europe", "eu", "uk", "france", "germany", "spain", "italy", "ukraine"], [35.0, 72.0, -25.0, 45.0]),
    ("north-america", "region", "North America", [], ["united states", "us", "canada", "mexico", "washington"], [14.0, 72.0, -170.0, -50.0]),
    ("latin-america", "region", "Latin America", [], ["brazil", "argentina", "colombia", "chile", "peru", "venezuela"], [-56.0, 14.0, -120.0, -30.0]),
    ("middle-east", "region", "Middle East", [], ["israel", "gaza", "iran", "syria", "saudi", "lebanon", "iraq"], [12.0, 42.0, 25.0, 63.0]),
    ("africa", "region", "Africa", [], ["africa", "nigeria", "kenya", "south africa", "ethiopia", "sudan", "uganda"], [-35.0, 37.0, -18.0, 52.0]),
    ("asia", "region", "Asia", [], ["china", "japan", "india", "korea", "taiwan", "indonesia", "philippines"], [-11.0, 55.0, 63.0, 150.0]),
    ("oceania", "region", "Oceania", [], ["australia", "new zealand", "pacific", "papua"], [-50.0, 0.0, 110.0, 180.0]),
]

INTEREST_TYPE = T.StructType([
    T.StructField("interest_id", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("layers", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
])
TERM_TYPE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("relevance", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
])
LINK_ITEM_TYPE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("source", T.StringType()), T.StructField("label", T.StringType()),
])


def layer_category(layer: Column, default: str | None = None) -> Column:
    """Category of a layer as a constant map lookup (no join)."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(LAYER_CATEGORY.items())])
    found = F.try_element_at(pairs, layer)
    return found if default is None else F.coalesce(found, F.lit(default))


def layer_dim(spark: SparkSession) -> DataFrame:
    """Layer dimension: layer_id, category_id, category_label, default_on, position."""
    rows = [
        (layer, name, label, name in DEFAULT_CATEGORIES, position)
        for position, (layer, name, label) in enumerate(
            (layer, name, label) for name, (label, layers) in CATEGORIES.items() for layer in layers)
    ]
    return spark.createDataFrame(rows, "layer_id string, category_id string, category_label string, default_on boolean, position int")


def interest_dim(spark: SparkSession) -> DataFrame:
    """The interest catalogue as a small dimension."""
    return spark.createDataFrame(INTERESTS, INTEREST_TYPE)
