"""Labels for ages, sizes, scores and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay per day by rate, the one of other rates, and those of query intents.
DECAY = {"slow": 0.005, "medium": 0.05, "fast": 0.1}
OTHER_DECAY = 0.005
INTENT_DECAY = {"recency": 0.05, "historical": 0.0}
# Confidence by level, and that of other levels.
CONFIDENCE = {"high": 0.95, "medium": 0.75, "low": 0.5}
OTHER_CONFIDENCE = 0.95
# Least scores of the tiers.
HIGH, MEDIUM = 0.062, 0.054


def cases(value: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def age_in_days(created_at: Column, as_of: Column) -> Column:
    """Fractional days; negative for the future."""
    return F.timestamp_diff("MICROSECOND", created_at, as_of) / F.lit(8.64e10)


def decay_lambda(rate: Column) -> Column:
    return F.coalesce(cases(rate, DECAY, OTHER_DECAY), F.lit(OTHER_DECAY))


def adaptive_lambda(intent: Column, rate: Column) -> Column:
    return F.coalesce(cases(intent, INTENT_DECAY, None), decay_lambda(rate))


def decay(lam: Column, age: Column) -> Column:
    return F.exp(-lam * age)


def confidence_of(level: Column) -> Column:
    return F.coalesce(cases(level, CONFIDENCE, OTHER_CONFIDENCE), F.lit(OTHER_CONFIDENCE))


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "[HIGH]").when(score >= MEDIUM, "[MED] ").otherwise("[LOW] ")


def _ago(n: Column, unit: str) -> Column:
    return F.concat(F.floor(n).cast("string"), F.lit(f" {unit}s ago"))


def age_label(days: Column) -> Column:
    return (
        F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 7, _ago(days, "day")).when(days < 14, "1 week ago")
        .when(days < 30, _ago(days / 7, "week")).when(days < 60, "1 month ago").when(days < 365, _ago(days / 30, "month"))
        .when(days < 730, "1 year ago").otherwise(_ago(days / 365, "year"))
    )


def elapsed_label(seconds: Column) -> Column:
    """The largest whole unit of a span of whole seconds."""
    out = F.concat(seconds.cast("string"), F.when(seconds == 1, " second ago").otherwise(" seconds ago"))
    for size, unit in ((60, "minute"), (3600, "hour"), (86400, "day")):
        n = F.floor(seconds / size).cast("long")
        out = F.when(n > 0, F.concat(n.cast("string"), F.when(n > 1, f" {unit}s ago").otherwise(f" {unit} ago"))).otherwise(out)
    return out


def bytes_label(size: Column) -> Column:
    def unit(power: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", size / F.lit(float(1024**power)))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1, "KB"))
        .when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))
    )


def rounded_tenth(x: Column) -> Column:
    """To one decimal, halves upwards (for negative numbers, too)."""
    return F.floor(x * 10 + 0.5) / 10


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
