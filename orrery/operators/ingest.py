"""Validation and geographic scope of normalised records, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geo
from orrery.operators import merge


def judged(records: DataFrame, area: list | None, country: str | None = None) -> DataFrame:
    """records with disposition and reason.

    Order of checks: geometry, range of coordinates, title, time. National and global records pass;
    without a staged area, located ones are unscoped; a point outside whose exchanged coordinates are
    inside is suspect if its title names the country.
    """
    spatial = F.col("scope") == "spatial"
    reason = F.coalesce(
        F.when(spatial & (F.col("lon").isNull() | F.col("lat").isNull()), "missing geometry"),
        F.when(spatial & ~(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)), "coordinate out of range"),
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing title"),
        F.when(F.col("start_time").isNull(), "missing time"),
    )
    if area is None:
        inside = F.lit(None).cast("boolean")
        swapped = F.lit(False)
    else:
        point = lambda q: F.struct(F.lit(float(q[0])).alias("x"), F.lit(float(q[1])).alias("y"))
        shape = F.array(*[F.array(*[F.array(*map(point, ring)) for ring in p]) for p in area])
        inside = geo.in_multipolygon(F.col("lon"), F.col("lat"), shape)
        swapped = geo.in_multipolygon(F.col("lat"), F.col("lon"), shape) & F.lower("title").contains((country or "\0").lower())
    disposition = (
        F.when(F.col("reason").isNotNull(), "invalid").when(~spatial, "kept").when(inside.isNull(), "unscoped").when(inside, "kept").when(swapped, "suspect-swap").otherwise("outside")
    )
    return records.withColumn("reason", reason).withColumn("disposition", disposition)


def counters(judged_: DataFrame) -> DataFrame:
    return judged_.groupBy("disposition", "reason").agg(F.count(F.lit(1)).alias("n"))


def stored(old: DataFrame, judged_: DataFrame, at: str, replace: str | None = None) -> DataFrame:
    """The events table after a run: kept records by id, creation times kept; of an id's records, the last counts."""
    kept = judged_.where(F.col("disposition").isin("kept", "unscoped")).drop("disposition", "reason")
    new = kept.withColumns({"id": F.concat("source_id", F.lit(":"), "record_id"), "created_at": F.lit(at), "updated_at": F.lit(at)}).drop("record_id")
    whole = F.struct(*new.columns)
    new = new.withColumn("order__", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(whole, "order__").alias("r")).select("r.*")
    if replace is not None:
        return merge.replaced_source(old, new.select(*old.columns), replace)
    return merge.upserted(old, new.select(*old.columns))
