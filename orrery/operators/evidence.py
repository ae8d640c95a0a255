"""Evidence around a record: the ledger of a source's runs, a candidate's scenes and tiles, look-alikes of chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vector
from orrery.operators.vectors import best_per_place, example_query

#: The share of the smaller window above which two chips show one place; where look-alikes are sought; how a member is named.
SAME_PLACE, SCOPES = 0.5, ("other-places", "same-place", "all")
MEMBER, UNASSIGNED, NEWER = "member", "nearest cluster (unassigned chip)", "nearest cluster (chip newer than this version)"


def run_ledger(runs: DataFrame) -> DataFrame:
    """The state of each source from the append-only log of its runs.

    runs: source_id, run (rising within a source), started_at and finished_at (seconds), status (success, failed, or
    another that leaves the count alone, such as offline-snapshot), error, retry_after_s.
    Gives consecutive_failures since the last success, last_success, last_failure, last_error (null unless the last
    run failed), health, and next_allowed_at: what the last failure since then that named a wait asks for.
    Runs are added up where they are; what is joined is one row for each source.
    """
    won, lost = F.col("status") == "success", F.col("status") == "failed"
    last = runs.groupBy("source_id").agg(
        F.max(F.when(won, F.col("run"))).alias("won__"),
        F.max(F.when(won, F.col("started_at"))).alias("last_success"),
        F.max(F.when(lost, F.col("started_at"))).alias("last_failure"),
        F.max(F.struct("run", "status", "error", "retry_after_s")).alias("end__"),
    )
    since = F.col("won__").isNull() | (F.col("run") > F.col("won__"))
    wait = F.when(F.col("retry_after_s").isNotNull(), F.struct("run", (F.col("finished_at") + F.col("retry_after_s")).alias("until")))
    failed = runs.where(lost).join(last.select("source_id", "won__"), "source_id").where(since).groupBy("source_id").agg(F.count(F.lit(1)).alias("n__"), F.max(wait).alias("wait__"))
    end = F.col("end__")
    health = F.when(end["status"] == "success", "ok").when(end["status"] != "failed", end["status"]).when(end["retry_after_s"].isNotNull(), "rate-limited").otherwise("failed")
    return last.join(failed, "source_id", "left").select(
        "source_id", F.coalesce("n__", F.lit(0)).alias("consecutive_failures"), "last_success", "last_failure",
        F.when(end["status"] == "failed", end["error"]).alias("last_error"), health.alias("health"), F.col("wait__.until").alias("next_allowed_at"),
    )


def candidate_scenes(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    """candidates with their scenes, in order of time, and the two that show the change: the last clean look before
    it and the first look that supports it. candidates: id, supporting_scene_ids, last_clean_before, earliest_supported_after
    (days); scenes: id, acquired_at and what is to be shown. Ids of unknown scenes drop out.
    """
    shown = F.struct("acquired_at", F.col("scene_id").alias("id"), *[c for c in scenes.columns if c not in ("id", "acquired_at")])
    asked = candidates.select("id", F.explode(F.array_distinct("supporting_scene_ids")).alias("scene_id"))
    found = asked.join(scenes.withColumnRenamed("id", "scene_id"), "scene_id").groupBy("id").agg(F.array_sort(F.collect_list(shown)).alias("scenes"))
    on = lambda day: F.try_element_at(F.filter("scenes", lambda s: F.substring(s["acquired_at"], 1, 10) == F.substring(F.col(day), 1, 10)), F.lit(1))
    told = candidates.join(found, "id", "left")
    return told.withColumns({"evidence_before": on("last_clean_before"), "evidence_after": on("earliest_supported_after")})


def candidates_of_tiles(tiles: DataFrame, candidates: DataFrame) -> DataFrame:
    """tiles (tile_id) with the id of each candidate that holds them; a tile of none drops out."""
    held = candidates.select(F.col("id").alias("candidate_id"), F.explode(F.array_distinct("tile_ids")).alias("tile_id"))
    return tiles.join(held, "tile_id")


def _overlap(window: dict[str, object]) -> Column:
    """Share of the smaller window that a chip's window and a given one have in common; 0 in another area."""
    size = int(window["chip_px"])
    common = lambda at: F.greatest(F.lit(0), F.least(F.col(at) + F.col("chip_px"), F.lit(window[at] + size)) - F.greatest(F.col(at), F.lit(window[at])))
    share = common("row_off") * common("col_off") / F.pow(F.least(F.col("chip_px"), F.lit(size)), 2)
    return F.when(F.col("aoi_id") == F.lit(window["aoi_id"]), share).otherwise(0.0)


def similar_chips(chips: DataFrame, examples: list, negatives: list = (), scope: str = "other-places", limit: int = 20, start: str | None = None, end: str | None = None) -> DataFrame:
    """The chips most like the examples and unlike the negatives: rank, id, score, same_place and the window.

    chips: id, aoi_id, chip_px, row_off, col_off, acquired_at, embedding (unit). Only chips of the examples' sizes, none
    of the named ones; at other places, at the examples' own, or at all; but for the own places, one date of each
    window, the best. A few examples are named by hand, so their windows travel in the plan; chips are read
    once and each task keeps its best.
    """
    if scope not in SCOPES or not examples:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}, with one example at least")
    named = [*examples, *negatives]
    known = {r.id: r for r in chips.where(F.col("id").isin(named)).select("id", "aoi_id", "chip_px", "row_off", "col_off").collect()}
    missing = [c for c in named if c not in known]
    if missing:
        raise ValueError(f"not indexed: {missing}")
    query = example_query(chips.where(F.col("id").isin(named)), F.col("id").isin(list(examples)), F.col("id").isin(list(negatives)))
    if query is None:
        query = [0.0]
    windows = [known[c].asDict() for c in examples]
    same = F.greatest(*[_overlap(w) for w in windows], F.lit(0.0)) > SAME_PLACE
    found = chips.where(~F.col("id").isin(named) & F.col("chip_px").isin(sorted({w["chip_px"] for w in windows})))
    if start is not None:
        found = found.where(F.col("acquired_at") >= start)
    if end is not None:
        found = found.where(F.col("acquired_at") <= end)
    found = found.withColumn("same_place", same)
    if scope != "all":
        found = found.where(F.col("same_place") == (scope == "same-place"))
    scored = found.withColumn("score", vector.dot(vector.doubles(F.col("embedding")), vector.literal(query))).drop("embedding")
    if scope != "same-place":
        scored = best_per_place(scored, ["aoi_id", "row_off", "col_off", "chip_px"])
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # of limit rows


def discovered_by_reference(references: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """For each reference chip its cluster: reference, family, cluster and membership.

    A member's own cluster comes first; a member of none, or a chip newer than the version, gets the cluster with the nearest
    centroid of its family, however far. references: id, family, embedding; members: id, cluster; clusters: family,
    cluster, centroid.
    """
    own = references.join(members.select("id", F.col("cluster").alias("own__"), F.lit(True).alias("in__")), "id", "left")
    options = clusters.groupBy("family").agg(F.collect_list(F.struct("cluster", "centroid")).alias("options__"))  # as many as a family has clusters
    near = own.join(options, "family", "left").withColumn("v__", vector.doubles(F.col("embedding")))
    best = F.array_max(F.transform("options__", lambda o: F.struct(vector.dot(F.col("v__"), o["centroid"]).alias("sim"), (-o["cluster"]).alias("late"))))
    membership = F.when(F.col("own__").isNotNull(), MEMBER).when(F.col("in__"), UNASSIGNED).otherwise(NEWER)
    return near.select(F.col("id").alias("reference"), "family", F.coalesce("own__", -best["late"]).alias("cluster"), membership.alias("membership"))
