"""Event calendars: blackout ranges, tagging of bars, upcoming events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlake.sources.bars import check_range


def in_range(events: DataFrame, start: str, end: str) -> DataFrame:
    check_range(None, start, end)
    return events.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def upcoming(events: DataFrame, as_of: str, days: int) -> DataFrame:
    if days <= 0:
        raise ValueError("days must be positive")
    start = F.lit(as_of).cast("date")
    return events.filter(F.col("event_date").between(start, F.date_add(start, days)))


def blackout_days(events: DataFrame) -> DataFrame:
    """One row per calendar day covered by any event.

    An event covers a few days, so expanding it turns the interval join into an
    equi-join on the day, which shuffles or broadcasts like any other join.
    """
    days = F.explode(F.sequence(F.lit(0), F.col("impact_days") - 1))
    return (
        events.filter(F.col("impact_days") > 0)
        .select("event_date", days.alias("k"))
        .select(F.date_add("event_date", F.col("k")).alias("day"))
        .distinct()
    )


def tag_blackouts(bars: DataFrame, events: DataFrame, ts: str = "ts") -> DataFrame:
    covered = blackout_days(events).withColumn("is_blackout", F.lit(True))
    return (
        bars.withColumn("day", F.to_date(ts))
        .join(covered, "day", "left")
        .withColumn("is_blackout", F.coalesce("is_blackout", F.lit(False)))
        .drop("day")
    )


def outside_blackouts(bars: DataFrame, events: DataFrame, ts: str = "ts") -> DataFrame:
    return bars.withColumn("day", F.to_date(ts)).join(blackout_days(events), "day", "left_anti").drop("day")
