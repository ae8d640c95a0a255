"""Merges without a transactional table: each returns the new state as one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank__ = 1").drop("rank__")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", kept: tuple[str, ...] = ("source_id", "created_at"), order: str | None = None) -> DataFrame:
    """old with the rows of new by key: all columns are replaced but the kept ones.

    Of several new rows with one key, the last in order wins.
    """
    if order is not None:
        new = latest_per_key(new, [key], [F.col(order).desc()]).drop(order)
    n, o = new.alias("n"), old.alias("o")
    here = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in (key, *kept) else F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def replaced_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows replaced by key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_source(old: DataFrame, new: DataFrame, source: str, column: str = "source_id") -> DataFrame:
    """All rows of a source exchanged for new ones."""
    return old.where(~F.col(column).eqNullSafe(F.lit(source))).unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks; one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def rerun_kept(old: DataFrame, new: DataFrame, reviewed: Column, key: str = "id") -> DataFrame:
    """A rerun replaces what nobody reviewed; reviewed rows stay as they are."""
    kept = old.where(reviewed)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def superseded(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Version rows with the new one current and all others superseded."""
    return versions.withColumn("status", F.when(F.col("status") == "current", "superseded").otherwise(F.col("status"))).unionByName(new.withColumn("status", F.lit("current")), allowMissingColumns=True)


def retained(snapshots: DataFrame, keep: int, source: str = "source_id", stamp: str = "stamp") -> DataFrame:
    """The newest snapshots of each source."""
    return snapshots.withColumn("rank__", F.row_number().over(Window.partitionBy(source).orderBy(F.col(stamp).desc()))).where(F.col("rank__") <= keep).drop("rank__")
