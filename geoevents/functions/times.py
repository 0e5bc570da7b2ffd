"""Column expressions on timestamps. ``as_of`` is always given by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400
# Scoring windows and half-life.
RECENCY_FULL_HOURS = 24.0
RECENCY_HALF_HOURS = 168.0
HALF_LIFE_DAYS = 14.0


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (micros(as_of) - micros(ts)) / F.lit(1_000_000.0)


def epoch_ms(value: Column) -> Column:
    return F.timestamp_millis(value.cast("bigint"))


def epoch_s(value: Column) -> Column:
    return F.timestamp_seconds(value.cast("bigint"))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; null where it does not parse."""
    return text.try_cast("timestamp")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recency_score(ts: Column, as_of: Column) -> Column:
    """1 for a day, then linear to 0.5 at seven days; 0 without a time; future events score 1."""
    age = age_seconds(ts, as_of) / 3600.0
    span = RECENCY_HALF_HOURS - RECENCY_FULL_HOURS
    return (F.when(ts.isNull(), F.lit(0.0)).when(age <= RECENCY_FULL_HOURS, F.lit(1.0))
            .when(age >= RECENCY_HALF_HOURS, F.lit(0.5))
            .otherwise(1.0 - (age - RECENCY_FULL_HOURS) / span * 0.5))


def half_life_decay(ts: Column, as_of: Column) -> Column:
    """Halves every 14 days; unknown times count fully."""
    days = F.greatest(F.lit(0.0), age_seconds(ts, as_of) / float(DAY_SECONDS))
    return F.when(ts.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS))


def freshness(ts: Column, as_of: Column) -> Column:
    """1/(1 + age in units of three days); 0 without a time."""
    age = F.greatest(F.lit(0.0), age_seconds(ts, as_of))
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(1.0 / (1.0 + age / float(3 * DAY_SECONDS)))


def is_date_only(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(DAY_SECONDS * 1_000_000)) == 0


def short_date(ts: Column, as_of: Column) -> Column:
    return F.when(F.year(ts) == F.year(as_of), F.date_format(ts, "MMM d")).otherwise(F.date_format(ts, "MMM d, yyyy"))


def freshness_label(ts: Column, as_of: Column) -> Column:
    """Card label. Midnight means only the day is known, so no hours are claimed."""
    # The clock has millisecond precision.
    ms = F.floor(micros(as_of) / 1000) - F.floor(micros(ts) / 1000)
    days = F.datediff(as_of.cast("date"), ts.cast("date"))
    date = short_date(ts, as_of)
    number = lambda unit: F.floor(ms / unit).cast("string")
    by_day = F.when(days == 0, F.lit("Today")).when(days == 1, F.lit("Yesterday")).otherwise(date)
    by_age = (F.when(ms < -5 * 60_000, date).when(ms < 60_000, F.lit("Just now"))
              .when(ms < 3_600_000, F.concat(number(60_000), F.lit(" min ago")))
              .when(ms < 86_400_000, F.concat(number(3_600_000), F.lit(" h ago")))
              .when(ms < 2 * 86_400_000, F.lit("Yesterday"))
              .when(ms < 7 * 86_400_000, F.concat(number(86_400_000), F.lit(" days ago")))
              .otherwise(date))
    return F.when(ts.isNull(), F.lit("")).when(is_date_only(ts), by_day).otherwise(by_age)


def imagery_day(ts: Column, as_of: Column) -> Column:
    """UTC day of the event; a same-day or later event uses the day before ``as_of``."""
    return F.least(ts.cast("date"), F.date_sub(as_of.cast("date"), 1))


def temporal_relation(first: Column, second: Column, tolerance_hours: float = 0.0) -> Column:
    """struct(relation, gap_hours) of two times."""
    gap = (micros(second) - micros(first)) / 3_600_000_000.0
    relation = (F.when(F.abs(gap) <= tolerance_hours, F.lit("OVERLAPS"))
                .when(gap > 0, F.lit("PRECEDES")).otherwise(F.lit("FOLLOWS")))
    return F.struct(relation.alias("relation"), F.abs(gap).alias("gap_hours"))
