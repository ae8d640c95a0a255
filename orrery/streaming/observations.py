"""Streaming forms: the same projections as in batch, with state only where it is bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators import merge


def event_stream(spark: SparkSession, folder: str, schema: str, files_each: int = 1000) -> DataFrame:
    """New files of a landing folder as rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def daily_counts(events: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Events by day and type; a day closes when the watermark has passed it, so state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "type", "n")


def flagged_stale(events: DataFrame, now: str, hours: float, telemetry: list[str], time: str = "ts") -> DataFrame:
    """Late telemetry is kept and flagged, never dropped."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(time)) / 3600.0
    return events.withColumn("age_h", F.round(age, 2)).withColumn("stale", F.col("type").isin(telemetry) & (age > hours))


def merged_into(path: str, key: str, order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key under path, in buckets by key.

    A batch reads and writes anew the buckets that its keys fall into, and no others, and then a marker
    named after it; a batch that is run again finds its marker and does nothing, so each is applied once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = last_done(spark, path)
        if done is not None and done >= number:
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = {r.b for r in batch.select(bucket.alias("b")).distinct().collect()}  # buckets at most
        old = [p for b, p in live(spark, path).items() if b in touched]
        rows = batch.unionByName(spark.read.parquet(*old), allowMissingColumns=True) if old else batch
        if touched:
            merge.latest_per_key(rows, [key], [F.col(order).desc()]).withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/version={number}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done={number}")

    return apply


def _named(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    """Numbers and places of the folders name=number in a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [(int(n.split("=")[1]), f"{path}/{n}") for n in names if n.startswith(f"{name}=")]


def last_done(spark: SparkSession, path: str) -> int | None:
    """Number of the last complete batch."""
    return max((n for n, _ in _named(spark, path, "done")), default=None)


def live(spark: SparkSession, path: str) -> dict[int, str]:
    """Where each bucket's latest complete version lies."""
    done, out = last_done(spark, path), {}
    for number, place in sorted(_named(spark, path, "version")):
        if done is not None and number <= done:
            out |= dict(_named(spark, place, "bucket"))
    return out


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest row of each key after the last complete batch; None before the first."""
    places = list(live(spark, path).values())
    return spark.read.parquet(*places) if places else None


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the latest complete version, where versions are whole."""
    done = last_done(spark, path)
    return None if done is None else (done, f"{path}/version={done}")


def keep_latest(events: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """All that is there now, merged; the next run goes on from the checkpoint."""
    return events.writeStream.foreachBatch(merged_into(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_seconds(credits_a_day: int, credits_a_call: int = 4, share: float = 0.8, least: float = 90.0) -> float:
    """Seconds between polls that stay within a share of a daily budget."""
    return max(least, float(int(86_400 / max(credits_a_day * share / credits_a_call, 1)) + 1))


def backoff_seconds(failures: int, base: float = 90.0, most: float = 1800.0, retry_after: float | None = None) -> float:
    """Waiting after failures: doubling from the second on, at most half an hour, at least what the server asks for."""
    return max(min(most, base * 2 ** max(0, failures - 1)), retry_after or 0.0)
