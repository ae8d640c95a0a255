"""How a query is registered, and places derived from keys for tables that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(key: Column) -> Column:
    return F.lit(68.0) + (key.cast("bigint") * 7919 % 2900) / F.lit(100.0)


def lat_of(key: Column) -> Column:
    return F.lit(8.0) + (key.cast("bigint") * 104729 % 2900) / F.lit(100.0)


def lon_sql(key: str) -> str:
    return f"(68.0::DOUBLE + (({key}::BIGINT * 7919) % 2900)::DOUBLE / 100.0::DOUBLE)"


def lat_sql(key: str) -> str:
    return f"(8.0::DOUBLE + (({key}::BIGINT * 104729) % 2900)::DOUBLE / 100.0::DOUBLE)"


def haversine_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(12742017.6::DOUBLE * asin(sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as located observations; errors have no place."""
    e = table(spark, sf_dir, "events")
    located = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type").isin("view", "click"), "browsing").otherwise("acting").alias("category"),
        iso(F.col("ts")).alias("start_time"),
        F.lit(None).cast("string").alias("end_time"),
        F.when(located, lon_of(F.col("user_id"))).alias("lon"),
        F.when(located, lat_of(F.col("user_id"))).alias("lat"),
        F.col("props").alias("attributes"),
        "value",
        "user_id",
    )


EVENTS_SQL = f"""e AS (
  SELECT event_id AS id, event_type AS type, CASE WHEN event_type IN ('view', 'click') THEN 'browsing' ELSE 'acting' END AS category,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_time, CASE WHEN event_type <> 'error' THEN {lon_sql("user_id")} END AS lon,
    CASE WHEN event_type <> 'error' THEN {lat_sql("user_id")} END AS lat, props AS attributes, value, user_id
  FROM events)"""
