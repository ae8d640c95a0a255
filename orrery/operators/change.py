"""The change engine: looks -> yearly composites -> lasting transitions -> groups -> gates -> candidates.

``candidates`` runs it whole. Every step is a DataFrame operation keyed by area and tile, so an area of
any number of tiles is spread over the cluster; the growth of groups, whose outcome depends on the order of
seeds, runs in Python, for a bounded number of tiles at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import grid
from orrery.operators.governance import candidate_id
from orrery.staging import staged

#: Fixed values of the engine.
MONTHS, LEAST_LOOKS, LEAST_YEARS, AGREEMENT = range(1, 6), 2, 2, 0.75
SHARE_SHIFT, LEAST_SATELLITES, LEAST_TILES, TILE_M2 = 0.30, 2, 2, 10_000
GROUP_YEARS, MAJORITY, GREY_MARGIN, COLOUR_SHIFT = 1, 0.5, 0.10, 0.25
#: What a single look can tell, and the classes that are open land by colour.
OF_LOOK = {"water": "water", "vegetation": "vegetation", "bare": "open", "built": "open"}
OPEN_LAND = ("built", "soil")
#: Years in which a score's persistence is full, and the rises of share and falls of colour ratio at which its magnitude is.
FULL_YEARS, FULL_SHARE, FULL_COLOUR = 3, 0.6, 0.5
KEYS = ("tile_id",)
#: Tiles of one kind of change whose groups one task may find.
GROUP_TILES = 200_000


def red_blue_ratio(red: Column, blue: Column) -> Column:
    """Bare soil is redder than pavement; null where blue says nothing."""
    return F.when(blue > 0.005, red / blue)


def composite_class(water: Column, vegetation: Column, open_: Column) -> Column:
    """The class with a majority, or mixed."""
    return (
        F.when(water.isNull(), F.lit(None).cast("string"))
        .when(water >= MAJORITY, "water")
        .when(vegetation >= MAJORITY, "vegetation")
        .when(open_ >= MAJORITY, "open")
        .otherwise("mixed")
    )


def composites(looks: DataFrame, keys: Iterable[str] = KEYS, least_looks: int = LEAST_LOOKS, months: Iterable[int] = MONTHS) -> DataFrame:
    """A row for each tile and year of dry-season looks: counts, scenes, medians of clear looks and the class they give.

    looks: keys, date (ISO text), scene_id, land_class (null: masked), water, vegetation, open, red, blue.
    Medians, and with them the class, are null where too few looks are clear.
    """
    clear = F.col("land_class").isNotNull()
    enough = F.count_if(clear) >= least_looks
    values = {c: F.col(c) for c in ("water", "vegetation", "open")} | {"red_blue": red_blue_ratio(F.col("red"), F.col("blue"))}
    return (
        looks.where(F.substring("date", 6, 2).cast("int").isin(list(months)))
        .groupBy(*keys, F.substring("date", 1, 4).cast("int").alias("year"))
        .agg(
            F.count_if(clear).alias("looks"),
            F.count_if(~clear).alias("masked"),
            F.array_sort(F.collect_list(F.when(clear, F.col("scene_id")))).alias("scene_ids"),
            *[F.when(enough, F.median(F.when(clear, v))).alias(c) for c, v in values.items()],
        )
        .withColumn("class", composite_class(F.col("water"), F.col("vegetation"), F.col("open")))
    )


def colour_references(composited: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Median red/blue of each year's open tiles, to tell a tile from its season."""
    return composited.where(F.col("class") == "open").groupBy(*by, "year").agg(F.median("red_blue").alias("typical"))


def split_open(composited: DataFrame, references: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """composited with open land split in built, clearly greyer than its year's typical open land, and soil."""
    split = F.when(F.col("red_blue") <= F.col("typical") - GREY_MARGIN, "built").otherwise("soil")
    return composited.join(references, [*by, "year"], "left").withColumn("class", F.when(F.col("class") == "open", split).otherwise(F.col("class")))


def array_median(values: Column) -> Column:
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    at = lambda i: F.get(ordered, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def share_of(x: Column, label: Column) -> Column:
    """The share of a composite x that measures a class."""
    return F.when(label == "water", x["water"]).when(label == "vegetation", x["vegetation"]).otherwise(x["open"])


def transitions(years: DataFrame, keys: Iterable[str] = KEYS, agreement: float = AGREEMENT, least_years: int = LEAST_YEARS) -> DataFrame:
    """The best lasting change of class of each tile, over its years in order; one shuffle by tile.

    years: composites with their class. Every split with enough years on both sides is tried: the
    commonest class before and the commonest after must differ, neither be mixed, hold for the agreed
    share of their side, and the first and last year after must have the new one. The greatest sum of
    shares wins, then the earliest split.
    """
    given = {"water": "double", "vegetation": "double", "open": "double", "red_blue": "double", "masked": "bigint", "scene_ids": "array<string>"}
    for c in [c for c in given if c not in years.columns]:
        years = years.withColumn(c, F.lit(None).cast(given[c]))
    one = F.struct("year", "class", "water", "vegetation", "open", "red_blue", "scene_ids")
    y, n = F.col("y"), F.size("y")
    part = lambda k, after: F.slice(y, k + 1, n - k) if after else F.slice(y, 1, k)
    having = lambda xs, label: F.filter(xs, lambda x: x["class"] == label)

    def commonest(xs: Column) -> Column:
        labels = F.array_distinct(F.transform(xs, lambda x: x["class"]))
        return F.array_max(F.transform(labels, lambda c: F.struct(F.size(having(xs, c)).alias("m"), c.alias("c"))))["c"]

    def shares(t: Column) -> Column:
        share = lambda after, label: F.size(having(part(t["k"], after), label)) / F.size(part(t["k"], after))
        return F.struct((share(False, t["a"]) + share(True, t["b"])).alias("sum"), (-t["k"]).alias("late"), t["k"].alias("k"), t["a"].alias("a"), t["b"].alias("b"), share(False, t["a"]).alias("pa"), share(True, t["b"]).alias("pb"))

    lasting = lambda t: (F.element_at(y, t["k"] + 1)["class"] == t["b"]) & (F.element_at(y, n)["class"] == t["b"])
    splits = F.when(n >= 2 * least_years, F.sequence(F.lit(least_years), n - least_years)).otherwise(F.array().cast("array<int>"))
    tiles = years.groupBy(*keys).agg(F.sum("masked").alias("masked_looks"), F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), one))).alias("y"))
    tried = tiles.withColumn("t", F.transform(splits, lambda k: F.struct(k.alias("k"), commonest(part(k, False)).alias("a"), commonest(part(k, True)).alias("b"))))
    tried = tried.withColumn("t", F.filter("t", lambda t: (t["a"] != t["b"]) & (t["a"] != "mixed") & (t["b"] != "mixed") & lasting(t)))
    tried = tried.withColumn("t", F.array_max(F.filter(F.transform("t", shares), lambda t: (t["pa"] >= agreement) & (t["pb"] >= agreement)))).where("t is not null")
    a, b, k = F.col("t.a"), F.col("t.b"), F.col("t.k")
    before, after = part(k, False), part(k, True)
    of = lambda xs, f: array_median(F.transform(xs, f))
    return tried.select(
        *keys,
        a.alias("from_class"),
        b.alias("to_class"),
        F.array_max(F.transform(having(before, a), lambda x: x["year"])).alias("last_year_before"),
        F.element_at(after, 1)["year"].alias("first_year_after"),
        F.element_at(after, -1)["year"].alias("latest_year"),
        k.alias("years_before"),
        (n - k).alias("years_after"),
        F.col("t.pa").alias("agree_before"),
        F.col("t.pb").alias("agree_after"),
        of(before, lambda x: share_of(x, b)).alias("share_before"),
        of(after, lambda x: share_of(x, b)).alias("share_after"),
        F.coalesce(of(before, lambda x: x["red_blue"]), F.lit(0.0)).alias("red_blue_before"),
        of(after, lambda x: x["red_blue"]).alias("red_blue_after"),
        "masked_looks",
        F.flatten(F.transform(after, lambda x: x["scene_ids"])).alias("after_scene_ids"),
        F.flatten(F.transform(y, lambda x: x["scene_ids"])).alias("scene_ids"),
    )


def refined(looks: DataFrame, found: DataFrame, keys: Iterable[str] = KEYS, months: Iterable[int] = MONTHS) -> DataFrame:
    """found with last_clean_before, the last clear dry-season look of the old class, and earliest_after, the first later one of the new.

    Looks count from the last year before to the first year after. A look cannot tell built from soil:
    between those two, the last look of the one year and the first of the other stand.
    """
    keys = list(keys)
    both_open = F.col("from_class").isin(*OPEN_LAND) & F.col("to_class").isin(*OPEN_LAND)
    wanted = lambda label: F.when(F.col(label).isin(*OPEN_LAND), "open").otherwise(F.col(label))
    seen = F.element_at(F.create_map(*[F.lit(x) for pair in OF_LOOK.items() for x in pair]), F.col("land_class"))
    year = F.substring("date", 1, 4).cast("int")
    about = found.select(*keys, wanted("from_class").alias("old__"), wanted("to_class").alias("new__"), both_open.alias("open__"), "last_year_before", "first_year_after")
    near = (
        looks.where(F.substring("date", 6, 2).cast("int").isin(list(months)) & F.col("land_class").isNotNull())
        .select(*keys, "date", year.alias("year__"), seen.alias("seen__"))
        .join(about, keys)
        .where(F.col("year__").between(F.col("last_year_before"), F.col("first_year_after")))
    )
    old = F.when(F.col("open__"), F.col("year__") == F.col("last_year_before")).otherwise(F.col("seen__") == F.col("old__"))
    new = F.when(F.col("open__"), F.col("year__") == F.col("first_year_after")).otherwise(F.col("seen__") == F.col("new__"))
    dates = near.groupBy(*keys).agg(F.first("open__").alias("open__"), F.max(F.when(old, F.col("date"))).alias("last_clean_before"), F.collect_set(F.when(new, F.col("date"))).alias("new__"))
    later = F.filter("new__", lambda d: F.col("open__") | F.col("last_clean_before").isNull() | (d > F.col("last_clean_before")))
    return found.join(dates.select(*keys, "last_clean_before", F.array_min(later).alias("earliest_after")), keys, "left")


GROUPED = "aoi string, tile_id string, row int, col int, from_class string, to_class string, year int, seed string"
KIND = ["aoi", "from_class", "to_class"]


def _grown(frame: pd.DataFrame) -> pd.DataFrame:
    """frame with seeds. Rows that have one already are reached from it: their group goes on growing from there."""
    sources: dict[str, tuple[int, list[tuple[int, int]]]] = {}
    at, years, open_ = {}, {}, []
    for r in frame.itertuples(index=False):
        if r.seed is None:
            at[r.row, r.col] = r.tile_id
            years[r.tile_id] = r.year
            open_.append(r)
            sources[r.tile_id] = (r.year, [(r.row, r.col)])
    for r in frame.itertuples(index=False):
        if r.seed is not None:
            sources.setdefault(r.seed, (r.year, []))[1].append((r.row, r.col))
    seed_of: dict[str, str] = {}
    for seed in sorted(sources):
        year, front = sources[seed]
        takes = lambda t: t is not None and t not in seed_of and abs(years[t] - year) <= GROUP_YEARS  # noqa: E731,B023
        front = [p for p in front if takes(at.get(p))]
        seed_of |= dict.fromkeys((at[p] for p in front), seed)
        while front:
            row, col = front.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    near = at.get((row + dr, col + dc))
                    if takes(near):
                        seed_of[near] = seed
                        front.append((row + dr, col + dc))
    out = pd.DataFrame(open_, columns=frame.columns)
    return out.assign(seed=[seed_of[t] for t in out["tile_id"]])[[f.split()[0] for f in GROUPED.split(", ")]]


def grouped(tiles: DataFrame, most: int = GROUP_TILES, block: int | None = None) -> DataFrame:
    """aoi, tile_id, row, col, from_class, to_class, year and the group they fall in, named by its seed.

    Groups grow from seeds in the order of their ids as text, over the eight neighbours, and a member
    must have the seed's classes and a year within GROUP_YEARS of the seed's: the order decides. Tiles of
    other kinds, areas or places that do not touch never meet, so up to most tiles of one kind, and then
    up to most that touch each other, are one task; what is larger is decided in rounds (``_in_rounds``).
    """
    given = tiles.select("aoi", "tile_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "from_class", "to_class", F.col("year").cast("int").alias("year"))
    blank = F.lit(None).cast("string").alias("seed")
    grow = lambda df, by: df.groupBy(*by).applyInPandas(_grown, GROUPED)
    few = given.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*KIND)
    if not few.limit(1).count():
        return grow(given.select("*", blank), KIND)
    given = staged(given, "tiles")
    touching = staged(grid.labelled(given.join(few, KIND, "left_semi"), KIND, block), "touching")
    large = staged(touching.groupBy(*KIND, "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*KIND, "component"), "large")
    found = grow(given.join(few, KIND, "left_anti").select("*", blank), KIND).unionByName(grow(touching.join(large, [*KIND, "component"], "left_anti").select("*", blank), [*KIND, "component"]))
    if not large.limit(1).count():
        return found
    return found.unionByName(_in_rounds(touching.join(large, [*KIND, "component"], "left_semi").drop("component"), most, block))


def _in_rounds(tiles: DataFrame, most: int, block: int | None) -> DataFrame:
    """Seeds of tiles of which more touch than one task may hold.

    In a round, a source is an undecided tile, or a seed whose group may still grow. A tile's least source
    is the first, in the order of seeds, that reaches it over undecided tiles that it could take: in the
    layer of a year, whose tiles are those within GROUP_YEARS of it, the tiles that reach each other have
    one. A tile that no other source comes before is a seed; it takes the tiles that it reaches over tiles
    of which it is the least source, as nobody before it can. At least the first source of every part
    takes all that it reaches, so rounds end; parts that have become small enough end in one task each. As ids
    follow the places, decisions wait for each other along an area: rounds grow with its length, some ten jobs each.
    """
    columns = ["aoi", "tile_id", "row", "col", "from_class", "to_class", "year"]
    undecided, results = staged(tiles.select(*columns), "undecided"), []
    borders: DataFrame | None = None  # places of undecided tiles next to decided ones, with their seeds and the seeds' years
    while True:
        parts = staged(grid.labelled(undecided, KIND, block), "parts")
        large = staged(parts.groupBy(*KIND, "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*KIND, "component"), "large")
        small = parts.join(large, [*KIND, "component"], "left_anti").withColumn("seed", F.lit(None).cast("string"))
        if borders is not None:
            reached = parts.select(*KIND, "component", "row", "col").join(borders, [*KIND, "row", "col"])
            about = reached.join(large, [*KIND, "component"], "left_anti").withColumn("tile_id", F.lit(None).cast("string"))
            small = small.unionByName(about.select(small.columns))
        results.append(staged(small.groupBy(*KIND, "component").applyInPandas(_grown, GROUPED), "decided"))
        undecided = staged(parts.join(large, [*KIND, "component"], "left_semi").drop("component"), "undecided")
        if not undecided.limit(1).count():
            break
        layers = undecided.withColumn("layer", F.explode(F.sequence(F.col("year") - GROUP_YEARS, F.col("year") + GROUP_YEARS)))
        if borders is None:
            layers = layers.withColumn("near", F.lit(None).cast("string"))
        else:
            near = borders.groupBy(*KIND, "row", "col", F.col("year").alias("layer")).agg(F.min("seed").alias("near"))
            layers = layers.join(near, [*KIND, "row", "col", "layer"], "left")
        layers = staged(grid.labelled(layers, [*KIND, "layer"], block), "layers")
        own = F.when(F.col("layer") == F.col("year"), F.col("tile_id"))
        first = layers.groupBy(*KIND, "layer", "component").agg(F.min(F.least(own, "near")).alias("first"))
        known = layers.join(first, [*KIND, "layer", "component"])
        touched = (F.col("near") == F.col("first")) | (F.col("tile_id") == F.col("first"))
        least = known.groupBy(*columns).agg(F.min(F.struct("first", F.when(touched, 0).otherwise(1).alias("far"), F.col("layer").alias("seed_year"))).alias("least"))
        least = grid.labelled(staged(least.select(*columns, "least.*"), "least"), [*KIND, "first"], block)
        takes = staged(least, "taking")
        taken = takes.groupBy(*KIND, "first", "component").agg(F.min("far").alias("far")).where("far = 0").drop("far")
        decided = staged(takes.join(taken, [*KIND, "first", "component"], "left_semi").select(*columns, F.col("first").alias("seed"), "seed_year"), "decided")
        results.append(decided.drop("seed_year"))
        undecided = staged(undecided.join(decided.select(*KIND, "row", "col"), [*KIND, "row", "col"], "left_anti"), "undecided")
        beside = grid.neighbours(decided.select(*KIND, "row", "col", "seed", F.col("seed_year").alias("year"))).select(*KIND, F.col("near_row").alias("row"), F.col("near_col").alias("col"), "seed", "year").distinct()
        beside = beside if borders is None else beside.union(borders.select(beside.columns))
        borders = staged(beside.join(undecided.select(*KIND, "row", "col"), [*KIND, "row", "col"], "left_semi").distinct(), "borders")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def elongated(rows: Column, cols: Column, tiles: Column) -> Column:
    """A strip, or a thin diagonal."""
    long, short = F.greatest(rows, cols), F.least(rows, cols)
    return ((tiles >= 4) & (long / short >= 4)) | ((tiles >= 6) & (long >= 6) & (tiles / (rows * cols) < 0.35))


def change_class(before: Column, after: Column, strip: Column) -> Column:
    """A struct of class and direction."""
    says = lambda c, d: F.struct((c if isinstance(c, Column) else F.lit(c)).alias("class"), F.lit(d).alias("direction"))
    return (
        F.when(after == "water", says("water-extent", "expansion"))
        .when(before == "water", says("water-extent", "contraction"))
        .when(after == "built", says(F.when(strip, "road-development").otherwise("construction"), "appearance"))
        .when((before == "vegetation") & (after == "soil"), says("clearance", "disappearance"))
        .when(after == "vegetation", says("other", "appearance"))
        .otherwise(says("other", "disappearance"))
    )


def events(tiles: DataFrame, by: Iterable[str] = ("aoi", "from_class", "to_class", "seed")) -> DataFrame:
    """One row for each group of changed tiles: what its gates, score, dates and outline need.

    tiles: transitions with their dates, by, tile_id, row and col; with lon, lat and geometry (GeoJSON
    text of a polygon) where there are any. The window is honest: the earliest look of the new state, and
    the latest clean one before it.
    """
    by = list(by)
    shift = F.col("share_after") - F.col("share_before")
    drop = F.col("red_blue_before") - F.coalesce("red_blue_after", F.lit(0.0))
    extent = lambda c: F.max(c) - F.min(c) + 1
    more = []
    if "geometry" in tiles.columns:
        rings = F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"]
        collected = F.transform(F.array_sort(F.collect_list(F.struct("tile_id", rings.alias("rings")))), lambda x: x["rings"])
        more = [F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), collected.alias("coordinates"))).alias("geometry")]
    dates = [F.min("earliest_after").alias("earliest_supported_after"), F.collect_set("last_clean_before").alias("befores__")] if "earliest_after" in tiles.columns else []
    found = tiles.groupBy(*by).agg(
        F.array_sort(F.collect_list("tile_id")).alias("tile_ids"),
        F.count(F.lit(1)).alias("tiles"),
        elongated(extent("row"), extent("col"), F.count(F.lit(1))).alias("elongated"),
        F.min("years_before").alias("years_before"),
        F.min("years_after").alias("years_after"),
        F.sum("masked_looks").alias("masked"),
        F.median(shift).alias("share_shift"),
        F.median(drop).alias("colour_drop"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("after_scene_ids")), lambda s: F.split_part(s, F.lit("_"), F.lit(1))))).alias("satellites"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("scene_ids")))).alias("supporting_scene_ids"),
        F.avg("agree_before").alias("agree_before"),
        F.avg("agree_after").alias("agree_after"),
        F.min("latest_year").alias("latest_year"),
        F.min("first_year_after").alias("first_year_after"),
        F.median("red_blue_after").alias("red_blue_after"),
        F.round(F.sum(F.greatest(shift, F.lit(0.0))) * TILE_M2).cast("bigint").alias("area_min_m2"),
        *dates,
        *more,
    )
    found = found.withColumns({"area_m2": F.col("tiles") * TILE_M2, "area_max_m2": F.col("tiles") * TILE_M2})
    if dates:
        clean = F.filter("befores__", lambda d: F.col("earliest_supported_after").isNull() | (d < F.col("earliest_supported_after")))
        found = found.withColumn("last_clean_before", F.array_max(clean)).drop("befores__")
    return found


def gates(groups: DataFrame) -> DataFrame:
    """Events with their six gates (gate, passed, detail), whether all passed, and the uncalibrated score.

    The score is the mean of agreement before, agreement after, persistence and magnitude; it ranks a
    queue and is no probability. Between two kinds of open land, the colour ratio stands for the share.
    """
    gate = lambda name, ok, text: F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), text.alias("detail"))
    by_colour = F.col("from_class").isin(*OPEN_LAND) & F.col("to_class").isin(*OPEN_LAND)
    lasting = F.col("years_after") >= LEAST_YEARS
    satellites = F.size("satellites")
    say = F.format_string
    risen = say("share of '%s' pixels rose by %+.0f%%, at least 30%% needed", F.col("to_class"), 100 * F.col("share_shift"))
    fallen = say("red/blue ratio fell by %.2f, at least 0.25 needed; open land before and after", F.col("colour_drop"))
    checks = F.array(
        gate("1 quality", (F.col("years_before") >= LEAST_YEARS) & lasting, say("%d clear composite years before and %d after; %d masked looks left out", F.col("years_before"), F.col("years_after"), F.col("masked"))),
        gate("2 geometry", F.when(by_colour, F.col("colour_drop") >= COLOUR_SHIFT).otherwise(F.col("share_shift") >= SHARE_SHIFT), F.when(by_colour, fallen).otherwise(risen)),
        gate("3 radiometric", satellites >= LEAST_SATELLITES, say("new state seen by %d satellites (%s)", satellites, F.array_join("satellites", ", "))),
        gate("4 season", lasting, F.when(lasting, "dry seasons of different years compared").otherwise("new state seen in fewer than 2 dry seasons")),
        gate("5 size/shape", F.col("tiles") >= LEAST_TILES, say("%d tiles, %s", F.col("tiles"), F.when(F.col("elongated"), "a strip").otherwise("compact"))),
        gate("6 persistence", F.col("agree_after") >= AGREEMENT, say("new class in %.0f%% of later years, still there in %d", 100 * F.col("agree_after"), F.col("latest_year"))),
    )
    magnitude = F.when(by_colour, F.col("colour_drop") / FULL_COLOUR).otherwise(F.col("share_shift") / FULL_SHARE)
    parts = F.col("agree_before") + F.col("agree_after") + F.least(F.lit(1.0), F.col("years_after") / FULL_YEARS) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), magnitude))
    return (
        groups.withColumn("gates", checks)
        .withColumn("accepted", F.forall("gates", lambda g: g["passed"]))
        .withColumn("score", F.round(parts / 4, 3))
    )


def class_note(gated: DataFrame, references: DataFrame, by: Iterable[str] = ("aoi",)) -> DataFrame:
    """gated with a seventh, informative entry where colour told built from soil: it never decides."""
    typical = references.select(*by, F.col("year").alias("first_year_after"), "typical")
    say = F.format_string("after the change red/blue is %.2f, that of open land in %d %.2f; a heuristic that nobody validated", F.col("red_blue_after"), F.col("first_year_after"), F.col("typical"))
    note = F.struct(F.lit("class note").alias("gate"), F.lit(True).alias("passed"), F.when(F.col("red_blue_after").isNull() | F.col("typical").isNull(), "no colour reference for that year").otherwise(say).alias("detail"))
    about_open = F.col("from_class").isin(*OPEN_LAND) | F.col("to_class").isin(*OPEN_LAND)
    return gated.join(typical, [*by, "first_year_after"], "left").withColumn("gates", F.when(about_open, F.concat("gates", F.array(note))).otherwise(F.col("gates"))).drop("typical")


def candidates(looks: DataFrame, tiles: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """The whole engine: change candidates of every area, accepted or suppressed with reasons.

    looks: aoi, tile_id and what ``composites`` needs; tiles: aoi, tile_id, row, col, lon, lat, geometry.
    reviewed: ids that an analyst has decided about; they are left out, so that a merge keeps them.
    Areas with fewer than four composite years give none. Composites are staged, so that looks are read
    once for them and once more for the dates.
    """
    keys = ("aoi", "tile_id")
    c = staged(composites(looks, keys), "composites")
    enough = c.where("class is not null").groupBy("aoi").agg(F.count_distinct("year").alias("n")).where(F.col("n") >= 2 * LEAST_YEARS).select("aoi")
    references = staged(colour_references(c, ["aoi"]), "colours")
    found = transitions(split_open(c.join(enough, "aoi", "left_semi"), references, ["aoi"]), keys)
    dated = staged(refined(looks, staged(found, "transitions"), keys).join(tiles, list(keys)), "dated")
    seeds = grouped(dated.withColumn("year", F.col("first_year_after"))).select("aoi", "tile_id", "seed")
    told = class_note(gates(events(dated.join(seeds, list(keys)))), references)
    named = told.withColumn("kind", change_class(F.col("from_class"), F.col("to_class"), F.col("elongated")))
    out = named.select(
        candidate_id(F.col("aoi"), F.col("from_class"), F.col("to_class"), F.element_at("tile_ids", 1)).alias("id"),
        "aoi",
        F.col("kind.class").alias("change_class"),
        F.col("kind.direction").alias("direction"),
        *[c for c in told.columns if c not in ("aoi", "seed", "accepted")],
        F.lit("uncalibrated-score").alias("score_kind"),
        F.when(F.col("accepted"), "accepted").otherwise("suppressed").alias("status"),
        F.lit("unreviewed").alias("review_state"),
    )
    return out if reviewed is None else out.join(reviewed.select("id"), "id", "left_anti")


def failed_gates(gated: DataFrame) -> DataFrame:
    """How often each gate failed."""
    return gated.select(F.explode("gates").alias("g")).where("not g.passed").groupBy("g.gate").agg(F.count(F.lit(1)).alias("n"))


def persistent_share(looks: DataFrame, key: str, label: Column, least: float = 0.75) -> DataFrame:
    """Keys whose clear looks bear the label in the given share at least."""
    return looks.groupBy(key).agg(F.count_if(label).alias("hits"), F.count(label).alias("clear")).where((F.col("clear") > 0) & (F.col("hits") / F.col("clear") >= least))


def first_last(looks: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value of each key in order, and their difference."""
    at = F.struct(F.col(order), F.col(value).alias("v"))
    return looks.groupBy(key).agg(F.min(at).alias("f"), F.max(at).alias("l")).select(key, F.col("f.v").alias("first_value"), F.col("l.v").alias("last_value"), (F.col("l.v") - F.col("f.v")).alias("delta"))
