"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.queries import analytics, changes, evidence_queries, feed_queries, observations, rules  # noqa: F401
from orrery.queries.base import ORACLES, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return observations.events_near_point(spark, sf_dir)
