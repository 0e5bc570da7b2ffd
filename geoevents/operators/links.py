"""Answers about candidate links and enrichment: accepting, filtering and applying them.

The answers come from outside as tables; these operators decide what they change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score as M
from ..functions import text as X
from ..schema import LAYERS

MIN_CONFIDENCE = 0.3
MIN_PLAUSIBILITY = 0.5
MIN_MECHANISM = 20
DEFAULT_LOCAL_SIGNIFICANCE = 30.0


def has_chain(chain: Column) -> Column:
    return F.coalesce(F.size(chain) >= 2, F.lit(False))


def has_evidence(explicit: Column, knowledge: Column) -> Column:
    return F.coalesce(F.size(explicit) >= 1, F.lit(False)) | F.coalesce(F.size(knowledge) >= 1, F.lit(False))


def verdict_join(items: DataFrame, verdicts: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Items with the answer given for them in their own batch. Answers for anything else are ignored; the rest stay unanswered.

    Of several answers for one item the last by ``order`` counts, without an order the greatest as a whole.
    """
    answers = [c for c in verdicts.columns if c not in keys]
    once = verdicts.groupBy(*keys).agg(F.max_by(F.struct(*answers), F.struct(*answers) if order is None else order).alias("answer"))
    joined = items.join(once, keys, "left")
    return joined.withColumn("answered", F.col("answer").isNotNull()).select(*items.columns, "answered", *[F.col("answer").getField(c).alias(c) for c in answers])


def geocode_fallback(items: DataFrame, gazetteer: DataFrame, centroids: DataFrame) -> DataFrame:
    """Coordinates of the looked-up place, else the centre of the publisher's country, else (0, 0).

    Input: items (place, specificity, country, …); gazetteer (place, lat, lng); centroids (country, lat, lng).
    """
    fine = F.col("specificity").isin("precise", "city", "region", "country") & (F.col("place") != "")
    found = items.join(gazetteer.toDF("place", "glat", "glng"), "place", "left").join(centroids.toDF("country", "clat", "clng"), "country", "left")
    hit = fine & F.col("glat").isNotNull()
    pick = lambda g, c: F.when(hit, F.col(g)).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return (found.withColumn("lat", pick("glat", "clat")).withColumn("lng", pick("glng", "clng"))
            .withColumn("geo_precision", F.when(hit, M.geo_precision_from_specificity(F.col("specificity"))).otherwise(F.lit("country")))
            .withColumn("geo_source", F.when(hit, F.lit("openstreetmap")).otherwise(F.lit("centroid"))).drop("glat", "glng", "clat", "clng"))


def news_disaster_links(verdicts: DataFrame) -> DataFrame:
    """Links that state a real mechanism. Input: news_id, disaster_id, relationship, type, confidence, mechanism, evidence."""
    mechanism = F.coalesce("mechanism", F.lit(""))
    good = (F.col("relationship") & (F.col("confidence") >= MIN_CONFIDENCE) & ~X.has_phrase(mechanism, X.GENERIC_PHRASES)
            & ~X.has_phrase(mechanism, X.SPECULATIVE_PHRASES) & (F.char_length(mechanism) >= MIN_MECHANISM) & F.coalesce(F.size("evidence") >= 1, F.lit(False)))
    kind = F.coalesce("type", F.lit("MENTIONS"))
    return verdicts.filter(good).select(
        F.concat_ws(":", F.lit("link"), "news_id", "disaster_id").alias("link_id"), F.col("news_id").alias("source_id"), F.col("disaster_id").alias("target_id"),
        X.relation_norm(kind).alias("relation"), F.when(kind == "PRIMARY_STORY", F.lit("merge")).otherwise(F.lit("link")).alias("display"),
        "confidence", mechanism.alias("rationale"))


def news_news_links(hypotheses: DataFrame) -> DataFrame:
    """Links whose hypothesis was plausible, verified, chained and evidenced.

    Input: source_id, article_id, type, plausibility, causal_chain, accept, confidence, mechanism, evidence, knowledge.
    """
    good = ((F.col("plausibility") >= MIN_PLAUSIBILITY) & F.coalesce("accept", F.lit(False)) & (F.col("confidence") >= MIN_CONFIDENCE)
            & has_chain(F.col("causal_chain")) & has_evidence(F.col("evidence"), F.col("knowledge")))
    return hypotheses.filter(good).select(
        F.concat_ws(":", F.lit("link"), "source_id", "article_id").alias("link_id"), "source_id", F.col("article_id").alias("target_id"),
        X.relation_norm(F.col("type")).alias("relation"), "confidence", X.rationale(F.col("mechanism"), F.col("causal_chain"), F.col("evidence")).alias("rationale"))


def enrichment_merge(events: DataFrame, answers: DataFrame) -> DataFrame:
    """Events with the acceptable parts of their enrichment.

    events: id, layer_id, summary, significance, keywords, geo_source, place, specificity; answers: id and the same with prefix ``new_``.
    """
    joined = events.join(answers, "id", "left")
    layer = F.when(F.col("new_layer_id").isin(LAYERS), F.col("new_layer_id")).otherwise(F.col("layer_id"))
    summary = F.when(F.coalesce("new_summary", F.lit("")) != "", F.col("new_summary")).otherwise(F.col("summary"))
    significance = F.when(F.col("new_significance").between(0, 100), F.floor("new_significance").cast("double")).otherwise(F.col("significance"))
    native = F.col("geo_source") == "native"
    specificity = F.when(native | F.col("answered").isNull(), F.col("specificity")).otherwise(F.coalesce("new_specificity", F.lit("global")))
    return joined.select("id", layer.alias("layer_id"), summary.alias("summary"), significance.alias("significance"),
                         F.coalesce("new_keywords", "keywords").alias("keywords"), specificity.alias("specificity"), "geo_source")


def default_significance(events: DataFrame, value: float = 50.0) -> DataFrame:
    """Without a model, events that were never rated get the middle value."""
    return events.withColumn("significance", F.when(F.col("significance") == 0, F.lit(value)).otherwise(F.col("significance")))


def locality(about: Column, publisher_country: Column) -> Column:
    """struct(about, is_local, reason): a story is local if it is about the publisher's country."""
    about = F.upper(F.trim(F.coalesce(about, F.lit(""))))
    local = about == publisher_country
    reason = F.when(~local, F.when(about != "", F.concat(F.lit("about "), about, F.lit(", publisher in "), publisher_country)).otherwise(F.lit("international story, no single country")))
    return F.struct(F.nullif(about, F.lit("")).alias("about"), local.alias("is_local"), reason.alias("reason"))
