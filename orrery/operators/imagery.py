"""Scenes, pairs, chips and layers: eligibility, choice, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geo, rules
from orrery.operators.governance import STATES


#: Clear pixels that a darkest percentile needs, and counts under and over which it tells of an offset.
DARK_PIXELS, NO_OFFSET_BELOW, OFFSET_ABOVE = 100, 600.0, 1000.0


def ineligible(scenes: DataFrame) -> DataFrame:
    """scenes with the reason for which one cannot be used; null for the usable."""
    reason = F.coalesce(
        F.when(~F.coalesce("quality_status", F.lit("")).isin("usable", "degraded"), F.concat(F.lit("quality is "), F.coalesce("quality_status", F.lit("unknown")))), F.when(F.col("file").isNull(), "file missing"), F.when(F.col("offset").isNull(), "offset unknown")
    )
    return scenes.withColumn("reason", reason)


def best_of_month(items: DataFrame, held: DataFrame, most: int = 3) -> DataFrame:
    """The best scenes of each month not held yet: those that cover the area, with less cloud, newer."""
    month = F.substring("acquired_at", 1, 7)
    open_ = items.withColumn("month", month).join(held.select(F.substring("acquired_at", 1, 7).alias("month")).distinct(), "month", "left_anti")
    order = Window.partitionBy("month").orderBy(F.desc("covers"), F.col("cloud").asc_nulls_last(), F.desc("version"), "id")
    return open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def admissible(pairs: DataFrame, most_shift: float = 1.0, least_clear: float = 0.5) -> DataFrame:
    """Pairs of scenes with the problems that forbid a comparison and warnings that do not.

    pairs: structs before and after of scenes, shift_px and joint_clear.
    """
    b, a = F.col("before"), F.col("after")
    gap = rules.month_gap(F.substring(b["acquired_at"], 6, 2).cast("int"), F.substring(a["acquired_at"], 6, 2).cast("int"))
    problems = [(b["aoi_id"] != a["aoi_id"], "different areas"), (b["acquired_at"] >= a["acquired_at"], "not in order of time"), (b["grid"] != a["grid"], "different grids"), (F.col("shift_px") > most_shift, "shifted"), (F.col("joint_clear") < least_clear, "too few clear pixels")]
    warnings = [(gap > 1, "different seasons"), (F.col("shift_px") > most_shift / 2, "slightly shifted")]
    listed = lambda rows: F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rows]), lambda m: m.isNotNull())
    return pairs.withColumn("problems", listed(problems)).withColumn("warnings", listed(warnings))


def suggested(scenes: DataFrame) -> DataFrame:
    """Pairs of one area, grid and season in different years; the longest span first."""
    key = ["aoi_id", "grid"]
    a = scenes.select(*key, F.col("id").alias("before"), F.col("acquired_at").alias("t0"))
    b = scenes.select(*key, F.col("id").alias("after"), F.col("acquired_at").alias("t1"))
    year, month = lambda c: F.substring(c, 1, 4).cast("int"), lambda c: F.substring(c, 6, 2).cast("int")
    pairs = a.join(b, key).where((F.col("t0") < F.col("t1")) & (year("t0") != year("t1")) & (rules.month_gap(month("t0"), month("t1")) <= 1))
    return pairs.withColumn("years", year("t1") - year("t0")).orderBy(F.desc("years"), "before", "after")


def chip_windows(scenes: DataFrame, sizes: tuple[int, ...] = (224, 112)) -> DataFrame:
    """scene_id, chip_px, row_off and col_off of the chips that cover each scene. scenes: id, height, width."""
    px = scenes.withColumn("chip_px", F.explode(F.array(*map(F.lit, sizes))))
    out = None
    for size in sizes:
        one = px.where(F.col("chip_px") == size).withColumn("row_off", F.explode(geo.window_offsets(F.col("height"), size))).withColumn("col_off", F.explode(geo.window_offsets(F.col("width"), size)))
        out = one if out is None else out.union(one)
    return out.select(F.col("id").alias("scene_id"), "chip_px", "row_off", "col_off")


def uncached(chips: DataFrame, cached: DataFrame) -> DataFrame:
    """Chips that no cache holds for the same model and preprocessing."""
    return chips.join(cached.select("id", "model_key", "preprocess_version"), ["id", "model_key", "preprocess_version"], "left_anti")


def runs_needed(pairs: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Pairs of scenes that no stored run holds for the same model and preprocessing; all of them if forced."""
    key = ["before_scene_id", "after_scene_id", "model_key", "preprocess_version"]
    return pairs if force else pairs.join(runs.select(*key), key, "left_anti")


def radiometry_rechecked(scenes: DataFrame) -> DataFrame:
    """scenes with the offset that their own tags give, and what follows: ok, corrected or quarantined.

    scenes: id, offset (as stored), baseline and applied (the tags), n_clear and p1 (how many clear pixels,
    and the darkest percentile of their counts). Very dark pixels speak against an offset in the counts,
    bright darkest ones for it; where they contradict the tags, or the tags don't decide, a scene goes aside.
    """
    told = rules.offset_of(F.col("baseline"), F.col("applied"))
    enough = F.col("n_clear") >= DARK_PIXELS
    without, with_ = enough & (F.col("p1") < NO_OFFSET_BELOW), enough & (F.col("p1") > OFFSET_ABOVE)
    aside = told.isNull() | (without & (told != 0.0)) | (with_ & (told == 0.0))
    state = F.when(F.coalesce(aside, F.lit(True)), "quarantined").when(told.eqNullSafe(F.col("offset")), "ok").otherwise("corrected")
    return scenes.withColumn("derived", told).withColumn("state", state)


def retrieval_state(model_staged: Column, eligible: Column, indexed: Column, running: Column) -> Column:
    return F.when(~model_staged | (eligible == 0), "NOT STAGED").when(running, "INDEXING").when(indexed == 0, "NOT STAGED").when(indexed < eligible, "PARTIAL").otherwise("READY")


def layer_states(layers: DataFrame, sources: DataFrame) -> DataFrame:
    """layer, best state of its sources and the newest update. layers: layer, type, source_id; sources: source_id, state, updated, n."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("state")), F.lit(99))
    joined = layers.join(sources, "source_id", "left")
    return joined.groupBy("layer").agg(F.min_by("state", rank).alias("state"), F.max("updated").alias("updated"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def enabled(available: Column, choice: Column, default: Column) -> Column:
    return available & F.coalesce(choice, default)
