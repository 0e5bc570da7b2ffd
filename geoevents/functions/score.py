"""Column expressions for parsing numbers and scoring events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hazard alert levels and the exposure scale.
ALERT_INTENSITY = {"red": 1.0, "orange": 0.6, "green": 0.25}
ALERT_SIGNIFICANCE = {"red": 90.0, "orange": 70.0, "green": 40.0}
FULL_EXPOSURE = 5_000_000.0
SPARSE_PEOPLE = 500
# Weights of the request-based ranking.
W_COORD, W_KEYWORD, W_SIGNIFICANCE, W_RECENCY = 0.3, 0.4, 0.2, 0.1
COORD_SCORE_MAX_KM = 5000.0


def num(text: Column) -> Column:
    """Number from text; blank and unreadable values become null."""
    return F.nullif(text.cast("string"), F.lit("")).try_cast("double")


def finite(text: Column) -> Column:
    """As ``num``, with NaN and infinities null too."""
    value = num(text)
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def whole(text: Column) -> Column:
    """Integer part of a number, towards zero."""
    return finite(text).try_cast("bigint")


def _level(level: Column) -> Column:
    return F.lower(F.trim(level))


def alert_intensity(level: Column) -> Column:
    name = _level(level)
    return F.when(name == "red", ALERT_INTENSITY["red"]).when(name == "orange", ALERT_INTENSITY["orange"]).when(
        name == "green", ALERT_INTENSITY["green"])


def hazard_intensity(category, magnitude, max_frp, max_wind_kmh, alert_level) -> Column:
    """Strength on 0–1; null where the kind has no usable measure."""
    cap = lambda value, full: F.least(F.lit(1.0), value / full)
    alert = alert_intensity(alert_level)
    return (F.when(category == "earthquake", F.when(magnitude.isNotNull(), cap(magnitude, 8.0)))
            .when(category == "wildfire", F.when(max_frp.isNotNull(), cap(max_frp, 50.0)).otherwise(alert))
            .when(category == "cyclone", F.when(max_wind_kmh.isNotNull(), cap(max_wind_kmh, 200.0)).otherwise(alert))
            .when(category.isin("flood", "volcano"), alert))


def impact_score(level: Column, people: Column) -> Column:
    reach = F.least(F.lit(1.0), F.log10(people + 1.0) / F.log10(F.lit(FULL_EXPOSURE)))
    return 100.0 * F.greatest(F.lit(0.0), level) * F.greatest(F.lit(0.0), reach)


def impact_class(score: Column, people: Column) -> Column:
    """Bands at 25, 50 and 75; sparse places stay at Moderate or below."""
    return (F.when(score < 25, F.lit("Low")).when((score < 50) | (people < SPARSE_PEOPLE), F.lit("Moderate"))
            .when(score < 75, F.lit("High")).otherwise(F.lit("Severe")))


def alert_significance(level: Column, score: Column) -> Column:
    """Named alert level first, then thirty per alert point, else 20."""
    name = F.lower(level)
    return (F.when(name == "red", ALERT_SIGNIFICANCE["red"]).when(name == "orange", ALERT_SIGNIFICANCE["orange"])
            .when(name == "green", ALERT_SIGNIFICANCE["green"])
            .when(score.isNotNull(), F.least(F.lit(100.0), score * 30.0)).otherwise(F.lit(20.0)))


def conflict_significance(fatalities: Column, civilian_targeting: Column) -> Column:
    deaths = F.least(F.lit(30.0), F.coalesce(fatalities, F.lit(0)) * 5.0)
    targeted = F.when(F.length(F.trim(F.coalesce(civilian_targeting, F.lit("")))) > 0, 15.0).otherwise(0.0)
    return F.least(F.lit(100.0), 55.0 + deaths + targeted)


def goldstein_significance(goldstein: Column) -> Column:
    return F.least(F.lit(100.0), 55.0 + F.abs(F.coalesce(num(goldstein), F.lit(0.0))) * 4.5)


def geo_precision_from_code(code: Column) -> Column:
    value = whole(code)
    return F.when(value == 2, F.lit("city")).when(value == 3, F.lit("region")).otherwise(F.lit("point"))


def geo_precision_from_place(place: Column) -> Column:
    vague = F.contains(F.lower(place), F.lit("(general)")) | ~F.contains(place, F.lit(","))
    return F.when(vague, F.lit("region")).otherwise(F.lit("city"))


def geo_precision_from_specificity(value: Column) -> Column:
    return (F.when(value == "precise", F.lit("point"))
            .when(value.isin("global", "continent", "country", "region", "city"), value).otherwise(F.lit("unknown")))


def significance_norm(significance: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), significance / 100.0))


def coord_score(distance_km: Column) -> Column:
    """Linear decay to 0 at 5,000 km; neutral 0.5 without coordinates."""
    near = F.greatest(F.lit(0.0), 1.0 - distance_km / COORD_SCORE_MAX_KM)
    return F.when(distance_km.isNull(), F.lit(0.5)).otherwise(near)


def composite_score(coord: Column, keyword: Column, significance: Column, recency: Column) -> Column:
    return W_COORD * coord + W_KEYWORD * keyword + W_SIGNIFICANCE * significance_norm(significance) + W_RECENCY * recency


def kind_measure(category: Column, severity: Column, unit: Column) -> Column:
    """Severity by the column its unit makes it: struct(magnitude, max_wind_kmh, ...)."""
    unit = F.lower(F.coalesce(unit, F.lit("")))
    has = lambda text: F.contains(unit, F.lit(text))
    return F.struct(
        F.when((category == "earthquake") & (has("m") | (unit == "")), severity).alias("magnitude"),
        F.when((category == "cyclone") & has("km"), severity).alias("max_wind_kmh"),
        F.when(category == "flood", severity).alias("flood_severity_score"),
        F.when((category == "drought") & has("km"), severity).alias("affected_area_km2"),
        F.when((category == "wildfire") & (unit != ""), severity).alias("burned_area_ha"),
    )
