"""Vector algebra on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def literal(values: list[float]) -> Column:
    """A query's vector as a constant: it travels with the plan, not as a join."""
    return F.array(*[F.lit(float(v)) for v in values])


def invalid_reason(v: Column, size: int, tolerance: float = 1e-3) -> Column:
    """Why an embedding is unusable: wrong length, not finite, not of unit length; null if it is usable."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull() | (F.size(v) != size), "wrong length").when(odd, "not finite").when(F.abs(norm(v) - 1) > tolerance, "not unit length")
    )


def element_means(rows: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group and the element-wise mean of its vectors, in order of position."""
    each = rows.select(*group, F.posexplode(vector).alias("i", "x")).groupBy(*group, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as deviations from the mean, in population deviations; a constant feature gives 0."""
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    z = {f: (F.col(f) - F.col(f"m_{f}")) / F.coalesce(F.nullif(F.col(f"s_{f}"), F.lit(0.0)), F.lit(1.0)) for f in features}
    return rows.join(F.broadcast(stats), F.lit(True)).withColumns(z).select(*rows.columns)
