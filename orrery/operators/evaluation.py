"""Metrics that are undefined rather than invented when nothing was measured."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_at(ranked: DataFrame, k: int, score: Column, relevant: Column, key: str = "id") -> DataFrame:
    """precision and n over the k best; an unjudged row counts as not relevant."""
    top = ranked.orderBy(score.desc(), key).limit(k)
    return top.agg(F.avg(F.coalesce(relevant, F.lit(False)).cast("int")).alias("precision"), F.count(F.lit(1)).alias("n"))


def average_precision(ranked: DataFrame, group: str, score: Column, relevant: Column, key: str = "id") -> DataFrame:
    """Mean of the precisions at the ranks of relevant rows, by group; null without any."""
    order = Window.partitionBy(group).orderBy(score.desc(), key)
    hit = F.coalesce(relevant, F.lit(False)).cast("int")
    at = ranked.withColumn("hit", hit).withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(group).agg(F.avg(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("average_precision"))


def binary_metrics(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and iou in one pass; null where undefined."""
    c = rows.agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, tp + fp + fn).alias("iou")
    )


def decision_seconds(log: DataFrame, key: str, at: str, opened: Column, decided: Column) -> DataFrame:
    """Seconds from the first opening since the last decision to each decision, by key."""
    order = Window.partitionBy(key).orderBy(at, "id")
    turn = F.sum(decided.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.where(opened | decided).withColumn("turn", F.coalesce(turn, F.lit(0)))
    return (
        marked.groupBy(key, "turn")
        .agg(F.min(F.when(opened, F.col(at))).alias("opened_at"), F.max(F.when(decided, F.col(at))).alias("decided_at"))
        .where(F.col("opened_at").isNotNull() & (F.col("decided_at") >= F.col("opened_at")))
        .select(key, "turn", (F.unix_timestamp("decided_at") - F.unix_timestamp("opened_at")).alias("seconds"))
    )


def seal(manifest: dict) -> str:
    """Digest of a manifest's canonical text without its own seal."""
    from orrery.operators.governance import canonical_json

    return hashlib.sha256(canonical_json({k: v for k, v in manifest.items() if k != "content_sha256"}).encode()).hexdigest()


def manifest_problems(entries: DataFrame, scenes: DataFrame) -> DataFrame:
    """entry_id and problem. entries: entry_id, scene_id, sha256, split; scenes: id, sha256.

    Unknown scenes, checksums that differ, entries twice, and scenes in more than one split.
    """
    joined = entries.join(scenes.select(F.col("id").alias("scene_id"), F.col("sha256").alias("held")), "scene_id", "left")
    unknown = joined.where("held is null").select("entry_id", F.lit("unknown scene").alias("problem"))
    altered = joined.where("held is not null and held <> sha256").select("entry_id", F.lit("checksum differs").alias("problem"))
    twice = entries.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry_id", F.lit("duplicate").alias("problem"))
    leaked = entries.groupBy("scene_id").agg(F.count_distinct("split").alias("n")).where("n > 1").join(entries, "scene_id").select("entry_id", F.lit("scene in several splits").alias("problem"))
    return unknown.union(altered).union(twice).union(leaked).distinct()


def site_outcomes(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """site_id and outcome (tp, fp, fn, tn) of labelled sites.

    labels: site_id, changed, tile_ids, first, last; candidates: tile_ids, latest_before, earliest_after
    of the accepted. A site is hit by a candidate that shares a tile and overlaps it in time: the join is
    on tiles, not on all pairs.
    """
    a = labels.select("site_id", "first", "last", F.explode("tile_ids").alias("tile"))
    b = candidates.select("latest_before", "earliest_after", F.explode("tile_ids").alias("tile"))
    hit = a.join(b, "tile").where((F.col("earliest_after") >= F.col("first")) & (F.col("latest_before") <= F.col("last"))).select("site_id").distinct().withColumn("hit", F.lit(True))
    found = labels.join(hit, "site_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    outcome = F.when(F.col("changed") & F.col("hit"), "tp").when(F.col("hit"), "fp").when(F.col("changed"), "fn").otherwise("tn")
    return found.select("site_id", outcome.alias("outcome"))


def date_error(pairs: DataFrame, found: str, reference: str) -> DataFrame:
    """Median and greatest absolute days between two dates; null without pairs."""
    days = F.abs(F.datediff(F.to_date(found), F.to_date(reference)))
    return pairs.agg(F.median(days).alias("median_days"), F.max(days).alias("max_days"), F.count(days).alias("n"))


def band_means(ranked: DataFrame, score: str, value: str, k: int = 10, key: str = "id") -> DataFrame:
    """Mean of a value among the k best, the k worst, and all: does a ranking follow it?"""
    best = ranked.orderBy(F.desc(score), key).limit(k).agg(F.lit("top").alias("band"), F.avg(value).alias("mean"))
    worst = ranked.orderBy(F.asc(score), key).limit(k).agg(F.lit("bottom").alias("band"), F.avg(value).alias("mean"))
    return best.union(worst).union(ranked.agg(F.lit("all").alias("band"), F.avg(value).alias("mean")))


def states_counted(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """Every state with its count, 0 where it has none."""
    counts = rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    return spine.join(counts, state, "left").select(state, F.coalesce("n", F.lit(0)).alias("n"))


def ranking_metrics(ranked: DataFrame, judgements: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """For each query of labels: status, precision and unjudged at each k, recall at k where the relevant set is whole, and average precision.

    ranked: query, rank (from 1) and id; judgements: query, id and relevant; labels: query, verified and
    exhaustive. Without a verified label that judges anything, nothing is measured and all figures are null.
    """
    judged = judgements.groupBy("query").agg(F.count(F.lit(1)).alias("judged"), F.count_if("relevant").alias("relevant"))
    rows = ranked.join(judgements, ["query", "id"], "left").withColumn("hit", F.coalesce("relevant", F.lit(False)))
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum(F.col("hit").cast("int")).over(order))
    at = lambda k, c: F.count_if((F.col("rank") <= k) & c)
    sums = rows.groupBy("query").agg(
        *[at(k, F.col("hit")).alias(f"hits_{k}") for k in ks],
        *[at(k, F.col("relevant").isNull()).alias(f"unjudged_at_{k}") for k in ks],
        F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank"))).alias("gain"),
        F.count_if("hit").alias("found"),
    )
    all_ = labels.join(judged, "query", "left").join(sums, "query", "left")
    measured = F.col("verified") & (F.coalesce("judged", F.lit(0)) > 0)
    whole = measured & F.col("exhaustive") & (F.col("relevant") > 0)
    base = F.when(F.col("exhaustive"), F.col("relevant")).otherwise(F.col("found"))
    return all_.select(
        "query",
        F.when(measured, "MEASURED").otherwise("NOT AVAILABLE").alias("status"),
        *[F.when(measured, F.coalesce(f"hits_{k}", F.lit(0)) / k).alias(f"precision_at_{k}") for k in ks],
        *[F.when(whole, F.coalesce(f"hits_{k}", F.lit(0)) / F.col("relevant")).alias(f"recall_at_{k}") for k in ks],
        *[F.when(measured, F.coalesce(f"unjudged_at_{k}", F.lit(0))).alias(f"unjudged_at_{k}") for k in ks],
        F.when(measured & (base > 0), F.coalesce("gain", F.lit(0.0)) / base).alias("average_precision"),
    )


def mask_metrics(predicted: DataFrame, truth: DataFrame, pairs: DataFrame, nodata: int = 255) -> DataFrame:
    """For each pair of scenes, tp, fp, fn, tn, precision, recall, f1 and iou of a change mask against a verified one.

    predicted, truth: pair, row, col and value (1: changed); pairs: pair, verified and grid_equal. Pixels
    without data on either side don't count; a pair without a verified mask, or on another grid, has nulls
    and says why.
    """
    p, t = predicted.where(F.col("value") != nodata), truth.where(F.col("value") != nodata)
    both = p.withColumnRenamed("value", "p").join(t.withColumnRenamed("value", "t"), ["pair", "row", "col"])
    count = lambda a, b: F.count_if(((F.col("p") == 1) == F.lit(a)) & ((F.col("t") == 1) == F.lit(b)))
    cells = both.groupBy("pair").agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    status = F.when(~F.col("verified"), "NOT AVAILABLE: no verified mask").when(~F.col("grid_equal"), "NOT AVAILABLE: another grid").otherwise("MEASURED")
    found = pairs.withColumn("status", status).join(cells, "pair", "left")
    fine, tp, fp, fn = F.col("status") == "MEASURED", F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(fine & (b > 0), a / b)
    return found.select(
        "pair", "status", *[F.when(fine, F.coalesce(c, F.lit(0))).alias(c) for c in ("tp", "fp", "fn", "tn")],
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("iou"),
    )
