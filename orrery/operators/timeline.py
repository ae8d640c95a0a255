"""Timelines: events by clamped day and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, first: str, last: str) -> Column:
    """Inclusive overlap of an event, which may lack an end, with a window of ISO texts."""
    return (F.coalesce(end, start) >= first) & (start <= last)


def within(start: Column, first: str | None, last: str | None) -> Column:
    """Half-open window of a search, compared as text."""
    out = F.lit(True)
    if first is not None:
        out = out & (start >= first)
    return out if last is None else out & (start < last)


def clamped_day(start: Column, first: str) -> Column:
    return F.greatest(F.substring(start, 1, 10), F.lit(first[:10]))


def density(events: DataFrame, first: str, last: str, types: list[str]) -> DataFrame:
    """day, category and n of the events of some types; none asked, none counted."""
    chosen = events.where(overlaps(F.col("start_time"), F.col("end_time"), first, last) & F.col("type").isin(types)) if types else events.limit(0)
    return chosen.groupBy(clamped_day(F.col("start_time"), first).alias("day"), "category").agg(F.count(F.lit(1)).alias("n"))


def telemetry(events: DataFrame, first: str, last: str, types: list[str]) -> DataFrame:
    """day and n of what is telemetry or has no place."""
    chosen = events.where(overlaps(F.col("start_time"), F.col("end_time"), first, last) & (F.col("type").isin(types) | F.col("lon").isNull()))
    return chosen.groupBy(clamped_day(F.col("start_time"), first).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def binned(days: DataFrame, first: str, last: str, most: int = 160) -> DataFrame:
    """bin (from 0), its first day and n over at most so many bins of equal days; bins without events have 0."""
    d0, d1 = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    per = F.ceil((F.datediff(d1, d0) + 1) / F.lit(most)).cast("int")
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(d0, d1)).alias("d")).withColumn("bin", F.floor(F.datediff("d", d0) / per).cast("int"))
    bins = spine.groupBy("bin").agg(F.min("d").cast("string").alias("first_day"))
    sums = days.withColumn("bin", F.floor(F.datediff(F.to_date("day"), d0) / per).cast("int")).groupBy("bin").agg(F.sum("n").alias("n"))
    return bins.join(sums, "bin", "left").select("bin", "first_day", F.coalesce("n", F.lit(0)).alias("n"))


def upcoming(events: DataFrame, now: str, until: str, scheduled: list[str]) -> DataFrame:
    return events.where(F.col("type").isin(scheduled) & (F.col("start_time") > now) & (F.col("start_time") <= until))
