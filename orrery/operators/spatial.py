"""Spatial joins without a spatial engine: grid-cell equi-joins with an exact residual.

A proximity join deals both sides over square cells; one side is repeated into the neighbouring cells
that its radius can reach, so each pair meets in exactly one cell and Catalyst plans an equi-join that
shuffles by cell, which adaptive execution can split where a cell is hot.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geo
from orrery.staging import staged

M_PER_DEGREE = math.pi * geo.EARTH_RADIUS_M / 180
HALF_ROUND_M = math.pi * geo.EARTH_RADIUS_M
#: Sites of a value that are joined without cells; radius of the first circle and how circles grow.
DIRECT, FIRST_M, GROWTH = 200, 2_000.0, 5.0


def _cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("int")


def proximity(left: DataFrame, right: DataFrame, radius_m: float, left_id: str = "id", right_id: str = "id", keep_self: bool = True, by: str | None = None) -> DataFrame:
    """a, b and distance_m of all pairs within radius, with equal values of by. Both sides: an id, lon and lat, and by.

    Cells are as high as the radius; a row looks as far east and west as its latitude needs. Near the
    poles it would look around the globe, so the search there is by row of cells only as far as that.
    """
    size = max(radius_m / M_PER_DEGREE, 1e-6) * 1.000001
    around = math.ceil(360 / size)
    a = left.select(F.col(left_id).alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a")).where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    b = right.select(F.col(right_id).alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")).where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if by is not None:
        a, b = (s.select(F.col(i).alias(n), F.col(by).alias("by__"), *[F.col(c).alias(f"{c}_{n}") for c in ("lon", "lat")]).where(F.col("lon").isNotNull() & F.col("lat").isNotNull()) for s, i, n in ((left, left_id, "a"), (right, right_id, "b")))
    b = b.withColumns({"cx": F.pmod(_cell(F.col("lon_b"), size), F.lit(around)), "cy": _cell(F.col("lat_b"), size)})
    top = F.least(F.abs(F.col("lat_a")) + size, F.lit(89.9))
    reach = F.least(F.ceil(1 / F.cos(F.radians(top))).cast("int") + 1, F.lit(around // 2 + 1))
    a = a.withColumn("cy", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: _cell(F.col("lat_a"), size) + i)))
    a = a.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(-reach, reach), lambda i: F.pmod(_cell(F.col("lon_a"), size) + i, F.lit(around))))))
    joined = a.join(b, ["cx", "cy"] + (["by__"] if by is not None else []))
    # a longitude of 180 may share cells on both ends of the globe: distinct cells per row make pairs unique
    distance = geo.haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    pairs = joined.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)
    if not keep_self:
        pairs = pairs.where(F.col("a") != F.col("b"))
    return pairs.select("a", "b", "distance_m")


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a, ties to the smaller b; Spark keeps k rows a group before the shuffle."""
    order = Window.partitionBy("a").orderBy("distance_m", "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_sites(places: DataFrame, sites: DataFrame, k: int, by: str) -> DataFrame:
    """by, lon, lat, b, distance_m and rank: of each place, the k nearest sites with its value of by, ties to the smaller id.

    places: by, lon and lat, distinct; sites: by, id, lon and lat. Values of by with few sites are joined
    as they are. For the others, places look around in growing circles by grid cells: one that finds k is
    done, as all within its circle was found; so the wide circles are left to lonely places.
    """
    keys = [by, "lon", "lat"]
    here = F.struct(*keys)
    sizes = sites.groupBy(by).agg(F.count(F.lit(1)).alias("n__"))
    small = sizes.where(F.col("n__") <= max(DIRECT, k)).select(by)
    beside = places.join(small, by, "left_semi").select(*keys).join(sites.select(by, F.col("id").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")), by)
    found = [beside.select(here.alias("a"), "b", geo.haversine(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b")).alias("distance_m"))]
    rest = places.join(sizes.where(F.col("n__") > max(DIRECT, k)).select(by), by, "left_semi").select(here.alias("id"), *keys)
    if rest.limit(1).count():
        radius, open_ = FIRST_M, staged(rest, "open")
        while open_.limit(1).count():
            near = staged(nearest_k(proximity(open_, sites, radius, by=by), k), "near")
            done = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= k) | F.lit(radius > HALF_ROUND_M)).select("a")
            found.append(near.join(done, "a", "left_semi").select("a", "b", "distance_m"))
            open_ = staged(open_.join(done, F.col("id") == F.col("a"), "left_anti"), "open") if radius <= HALF_ROUND_M else open_.limit(0)
            radius *= GROWTH
    ranked = nearest_k(reduce(DataFrame.union, found), k)
    return ranked.select("a.*", "b", "distance_m", "rank")


def nearest_of_kind(rows: DataFrame, key: str, kind: str, k: int) -> DataFrame:
    """a, b, kind, distance_m and rank: for each row with a place, the k nearest others of its kind.

    Rows at one spot have one list of neighbours, and of them only the k + 1 smallest keys can be anyone's
    neighbours: so a spot that many rows share costs no more than another.
    """
    placed = rows.select(F.col(key).alias("id"), F.col(kind).alias("kind"), "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    spot = Window.partitionBy("kind", "lon", "lat").orderBy("id")
    sites = placed.withColumn("r__", F.row_number().over(spot)).where(F.col("r__") <= k + 1).drop("r__")
    lists = nearest_sites(placed.select("kind", "lon", "lat").distinct(), sites, k + 1, "kind")
    pairs = placed.withColumnRenamed("id", "a").join(lists.drop("rank"), ["kind", "lon", "lat"]).where(F.col("a") != F.col("b"))
    return nearest_k(pairs.select("a", "b", "kind", "distance_m"), k)


def nearest_site(rows: DataFrame, sites: list[tuple[str, float, float]], key: str = "id") -> DataFrame:
    """The nearest of a short list of named sites (areas of interest): one expression, no join."""
    if not sites:
        return rows.select(key, F.lit(None).cast("string").alias("site"), F.lit(None).cast("double").alias("distance_m"))
    options = F.array_sort(F.array(*[F.struct(geo.haversine(F.col("lon"), F.col("lat"), x, y).alias("distance_m"), F.lit(name).alias("site")) for name, x, y in sites]))
    return rows.select(key, options[0].alias("n")).select(key, "n.site", "n.distance_m")


def inside_areas(rows: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """rows with the area they lie in, a row for each. areas: area and polygons (a multipolygon).

    Areas are repeated into the cells their boxes touch; a point meets only the areas of its cell, then
    the exact test decides.
    """
    box = geo.bbox_of(geo.positions(F.col("polygons")))
    dealt = (
        areas.withColumn("box", box)
        .where(F.col("box.west").isNotNull())
        .withColumn("cx", F.explode(F.sequence(_cell(F.col("box.west"), cell), _cell(F.col("box.east"), cell))))
        .withColumn("cy", F.explode(F.sequence(_cell(F.col("box.south"), cell), _cell(F.col("box.north"), cell))))
    )
    points = rows.withColumns({"cx": _cell(F.col("lon"), cell), "cy": _cell(F.col("lat"), cell)})
    within = geo.in_bbox(F.col("lon"), F.col("lat"), F.col("box.west"), F.col("box.south"), F.col("box.east"), F.col("box.north"))
    found = points.join(dealt, ["cx", "cy"]).where(within & geo.in_multipolygon(F.col("lon"), F.col("lat"), F.col("polygons")))
    return found.select(*[F.col(c) for c in rows.columns], "area")


def related(changes: DataFrame, events: DataFrame, radius_m: float = 50_000.0) -> DataFrame:
    """changes with the sorted list of events within radius (an empty one where there are none)."""
    pairs = proximity(changes, events, radius_m)
    lists = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("distance_m", "b"))).alias("related"))
    empty = F.array().cast(lists.schema["related"].dataType)
    return changes.join(lists, changes["id"] == F.col("a"), "left").withColumn("related", F.coalesce("related", empty)).drop("a")


def water_distance(changes: DataFrame, tiles: DataFrame, limit_m: float | None = None) -> DataFrame:
    """Metres from each change to the nearest water tile of its area; changes of areas without one go."""
    water = tiles.select("aoi_id", F.struct("lon", "lat").alias("id"), "lon", "lat").distinct()
    nearest = nearest_sites(changes.select("aoi_id", "lon", "lat").where("lon is not null and lat is not null").distinct(), water, 1, "aoi_id")
    told = changes.join(nearest.select("aoi_id", "lon", "lat", F.col("distance_m").alias("water_m")), ["aoi_id", "lon", "lat"]).select(*changes.columns, "water_m")
    return told if limit_m is None else told.where(F.col("water_m") <= limit_m)
