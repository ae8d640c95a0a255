"""The change engine over shipments read as looks at tiles.

Four parts of a row of tiles make a block; blocks turn to water, to bare soil or to pavement in a year of
their own, or stay. The SQL states the engine's rules by itself: majority classes of dry-season medians,
open land split by the year's typical colour, lasting transitions, date windows, six gates, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import change
from orrery.queries.base import query, table
from orrery.staging import staged

KEYS = ("aoi", "tile_id")


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aoi, tile_id, block, row, col, date, scene_id, land_class (null: masked), water, vegetation, open, red and blue."""
    tile = F.expr("cast(l_partkey div 4 as int)")
    block = F.expr("block")
    line = table(spark, sf_dir, "lineitem").withColumn("tile", tile).withColumn("block", F.expr("tile div 4"))
    kind, after = block % 4, F.year("l_shipdate") >= 1997 + block % 3
    shares = line.withColumns({
        "date": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "water": F.when(after & (kind == 0), 0.7 + F.col("l_discount")).otherwise(F.col("l_discount")),
        "vegetation": F.when((kind == 2) | (after & kind.isin(0, 1)), F.col("l_tax")).otherwise(0.7 + F.col("l_tax")),
        "blue": 0.05 + F.col("l_tax") / 10,
        "ratio": F.when(after & (kind == 2), 1.2).otherwise(1.6) + F.col("l_quantity") / 10_000,
    })
    return shares.select(
        F.concat(F.lit("a"), F.expr("tile div 1024").cast("string")).alias("aoi"),
        F.col("tile").alias("tile_id"),
        "block",
        F.expr("tile div 16").alias("row"),
        (F.col("tile") % 16).alias("col"),
        "date",
        F.concat(F.lit("S2"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B"), F.lit("_"), "date").alias("scene_id"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit(None).cast("string")).when(F.col("water") >= 0.5, "water").when(F.col("vegetation") >= 0.5, "vegetation").otherwise("bare").alias("land_class"),
        "water",
        "vegetation",
        (1 - F.col("water") - F.col("vegetation")).alias("open"),
        (F.col("blue") * F.col("ratio")).alias("red"),
        "blue",
    )


LOOKS_SQL = """l0 AS (SELECT *, l_partkey // 4 AS tile_id, l_partkey // 16 AS block, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
l1 AS (SELECT *, block % 4 AS kind, year(l_shipdate) >= 1997 + block % 3 AS after FROM l0),
l2 AS (SELECT *, 'a' || (tile_id // 1024) AS aoi, 'S2' || CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END || '_' || date AS scene_id,
  CASE WHEN after AND kind = 0 THEN 0.7::DOUBLE + l_discount ELSE l_discount END AS water,
  CASE WHEN kind = 2 OR (after AND kind IN (0, 1)) THEN l_tax ELSE 0.7::DOUBLE + l_tax END AS vegetation,
  0.05::DOUBLE + l_tax / 10 AS blue, CASE WHEN after AND kind = 2 THEN 1.2::DOUBLE ELSE 1.6::DOUBLE END + l_quantity / 10000 AS ratio FROM l1),
looks AS (SELECT aoi, tile_id, block, date, scene_id, water, vegetation, 1 - water - vegetation AS open, blue * ratio AS red, blue,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN water >= 0.5 THEN 'water' WHEN vegetation >= 0.5 THEN 'vegetation' ELSE 'bare' END AS land_class FROM l2),
dry AS (SELECT * FROM looks WHERE substr(date, 6, 2)::INTEGER <= 5),
c0 AS (SELECT aoi, tile_id, any_value(block) AS block, substr(date, 1, 4)::INTEGER AS year, count(land_class) AS looks, count(*) - count(land_class) AS masked,
    CASE WHEN count(land_class) >= 2 THEN median(water) FILTER (WHERE land_class IS NOT NULL) END AS water,
    CASE WHEN count(land_class) >= 2 THEN median(vegetation) FILTER (WHERE land_class IS NOT NULL) END AS vegetation,
    CASE WHEN count(land_class) >= 2 THEN median(open) FILTER (WHERE land_class IS NOT NULL) END AS open,
    CASE WHEN count(land_class) >= 2 THEN median(red / blue) FILTER (WHERE land_class IS NOT NULL AND blue > 0.005) END AS red_blue
  FROM dry GROUP BY aoi, tile_id, substr(date, 1, 4)),
c1 AS (SELECT *, CASE WHEN water IS NULL THEN NULL WHEN water >= 0.5 THEN 'water' WHEN vegetation >= 0.5 THEN 'vegetation' WHEN open >= 0.5 THEN 'open' ELSE 'mixed' END AS k FROM c0),
typical AS (SELECT aoi, year, median(red_blue) AS typical FROM c1 WHERE k = 'open' GROUP BY ALL),
comp AS (SELECT c1.*, typical, CASE WHEN k <> 'open' THEN k WHEN red_blue <= typical - 0.10::DOUBLE THEN 'built' WHEN k = 'open' THEN 'soil' END AS class FROM c1 LEFT JOIN typical USING (aoi, year))"""

TRANSITIONS_SQL = f"""{LOOKS_SQL},
y AS (SELECT *, row_number() OVER (PARTITION BY aoi, tile_id ORDER BY year) AS i, count(*) OVER (PARTITION BY aoi, tile_id) AS n FROM comp WHERE class IS NOT NULL),
tries AS (SELECT y.*, s.k AS split FROM y, unnest(range(2, y.n - 1)) AS s(k) WHERE y.n >= 4),
counted AS (SELECT aoi, tile_id, split, n, i > split AS later, class AS c, count(*) AS m, min(i) AS fi, max(i) AS li, max(year) AS ly FROM tries GROUP BY ALL),
lead AS (SELECT *, m::DOUBLE / CASE WHEN later THEN n - split ELSE split END AS share FROM counted WHERE m::DOUBLE / CASE WHEN later THEN n - split ELSE split END >= 0.75),
pair AS (SELECT a.aoi, a.tile_id, a.split, a.n, a.c AS from_class, b.c AS to_class, a.share AS agree_before, b.share AS agree_after, a.ly AS last_year_before
  FROM lead AS a JOIN lead AS b USING (aoi, tile_id, split) WHERE NOT a.later AND b.later AND a.c <> b.c AND a.c <> 'mixed' AND b.c <> 'mixed' AND b.fi = a.split + 1 AND b.li = a.n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi, tile_id ORDER BY agree_before + agree_after DESC, split) AS r FROM pair) WHERE r = 1),
lost AS (SELECT aoi, tile_id, sum(masked)::BIGINT AS masked_looks FROM comp GROUP BY ALL),
found AS (SELECT best.aoi, best.tile_id, any_value(y.block) AS block, from_class, to_class, last_year_before, min(year) FILTER (WHERE i > split) AS first_year_after, max(year) AS latest_year, split AS years_before, best.n - split AS years_after,
    agree_before, agree_after, any_value(masked_looks) AS masked_looks,
    median(CASE to_class WHEN 'water' THEN water WHEN 'vegetation' THEN vegetation ELSE open END) FILTER (WHERE i <= split) AS share_before,
    median(CASE to_class WHEN 'water' THEN water WHEN 'vegetation' THEN vegetation ELSE open END) FILTER (WHERE i > split) AS share_after,
    coalesce(median(red_blue) FILTER (WHERE i <= split), 0) AS red_blue_before, median(red_blue) FILTER (WHERE i > split) AS red_blue_after
  FROM best JOIN y USING (aoi, tile_id) JOIN lost USING (aoi, tile_id) GROUP BY best.aoi, best.tile_id, from_class, to_class, last_year_before, split, best.n, agree_before, agree_after)"""


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = staged(change.composites(looks(spark, sf_dir), KEYS), "composites")
    return change.split_open(c, change.colour_references(c, ["aoi"]), ["aoi"])


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.transitions(_composites(spark, sf_dir), KEYS)


@query(f"""WITH {LOOKS_SQL} SELECT aoi, tile_id, year, looks, masked, class, round(water, 6) AS water, round(vegetation, 6) AS vegetation, round(open, 6) AS open, round(red_blue, 6) AS red_blue, round(typical, 6) AS typical FROM comp""")
def yearly_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry-season medians by tile and year, with the class that shares and the year's colour give."""
    r = lambda c: F.round(c, 6).alias(c)
    return _composites(spark, sf_dir).select("aoi", "tile_id", "year", "looks", "masked", "class", *[r(c) for c in ("water", "vegetation", "open", "red_blue", "typical")])


MEASURES = ("agree_before", "agree_after", "share_before", "share_after", "red_blue_before", "red_blue_after")


@query(f"""WITH {TRANSITIONS_SQL} SELECT aoi, tile_id, from_class, to_class, last_year_before, first_year_after, latest_year, years_before, years_after, masked_looks, {", ".join(f"round({m}, 9) AS {m}" for m in MEASURES)} FROM found""")
def persistent_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lasting change of each tile's class, with what gates need of it."""
    t = _transitions(spark, sf_dir)
    whole = ("last_year_before", "first_year_after", "latest_year", "years_before", "years_after", "masked_looks")
    return t.select("aoi", "tile_id", "from_class", "to_class", *[F.col(c).cast("bigint").alias(c) for c in whole], *[F.round(m, 9).alias(m) for m in MEASURES])


REFINED_SQL = f"""{TRANSITIONS_SQL},
w AS (SELECT f.*, d.date, substr(d.date, 1, 4)::INTEGER AS year, CASE WHEN land_class IN ('bare', 'built') THEN 'open' ELSE land_class END AS seen, from_class IN ('built', 'soil') AND to_class IN ('built', 'soil') AS both_open
  FROM found AS f JOIN dry AS d USING (aoi, tile_id) WHERE land_class IS NOT NULL AND substr(d.date, 1, 4)::INTEGER BETWEEN last_year_before AND first_year_after),
o AS (SELECT aoi, tile_id, max(date) AS last_clean_before FROM w WHERE CASE WHEN both_open THEN year = last_year_before ELSE seen = CASE WHEN from_class IN ('built', 'soil') THEN 'open' ELSE from_class END END GROUP BY ALL),
e AS (SELECT w.aoi, w.tile_id, min(date) AS earliest_after FROM w LEFT JOIN o USING (aoi, tile_id)
  WHERE CASE WHEN both_open THEN year = first_year_after ELSE seen = CASE WHEN to_class IN ('built', 'soil') THEN 'open' ELSE to_class END AND (last_clean_before IS NULL OR date > last_clean_before) END GROUP BY ALL)"""


@query(f"""WITH {REFINED_SQL} SELECT aoi, tile_id, from_class, to_class, last_clean_before, earliest_after FROM found LEFT JOIN o USING (aoi, tile_id) LEFT JOIN e USING (aoi, tile_id)""")
def refine_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of dates that single looks leave open for each change."""
    found = change.refined(looks(spark, sf_dir), _transitions(spark, sf_dir), KEYS)
    return found.select("aoi", "tile_id", "from_class", "to_class", "last_clean_before", "earliest_after")


@query(f"""WITH {REFINED_SQL},
sat AS (SELECT found.block, from_class, to_class, count(DISTINCT split_part(scene_id, '_', 1)) AS satellites FROM found JOIN dry USING (aoi, tile_id) JOIN comp USING (aoi, tile_id)
  WHERE dry.land_class IS NOT NULL AND comp.class IS NOT NULL AND comp.year = substr(dry.date, 1, 4)::INTEGER AND comp.year >= first_year_after GROUP BY ALL),
ev AS (SELECT block, from_class, to_class, count(*) AS tiles, min(years_before) AS yb, min(years_after) AS ya, sum(masked_looks)::BIGINT AS masked, median(share_after - share_before) AS shift, median(red_blue_before - coalesce(red_blue_after, 0)) AS dropped,
    avg(agree_before) AS ab, avg(agree_after) AS aa, min(earliest_after) AS first_after, max(tile_id) - min(tile_id) + 1 AS width, round(sum(greatest(share_after - share_before, 0)) * 10000)::BIGINT AS area_min_m2
  FROM found LEFT JOIN o USING (aoi, tile_id) LEFT JOIN e USING (aoi, tile_id) GROUP BY ALL),
lb AS (SELECT ev.block, ev.from_class, ev.to_class, max(last_clean_before) AS last_before FROM ev JOIN found ON found.block = ev.block AND found.from_class = ev.from_class AND found.to_class = ev.to_class JOIN o USING (aoi, tile_id)
  WHERE first_after IS NULL OR last_clean_before < first_after GROUP BY ALL),
g AS (SELECT ev.*, satellites, last_before, from_class IN ('built', 'soil') AND to_class IN ('built', 'soil') AS colour, tiles >= 4 AND width >= 4 AS strip FROM ev LEFT JOIN sat USING (block, from_class, to_class) LEFT JOIN lb USING (block, from_class, to_class))
SELECT block, from_class, to_class, tiles, masked, satellites, area_min_m2, first_after, last_before, strip AS elongated,
  yb >= 2 AND ya >= 2 AS quality, CASE WHEN colour THEN dropped >= 0.25 ELSE shift >= 0.30 END AS geometry, satellites >= 2 AS radiometric, ya >= 2 AS season, tiles >= 2 AS size, aa >= 0.75 AS persistence,
  yb >= 2 AND ya >= 2 AND CASE WHEN colour THEN dropped >= 0.25 ELSE shift >= 0.30 END AND satellites >= 2 AND tiles >= 2 AND aa >= 0.75 AS accepted,
  round((ab + aa + least(1.0::DOUBLE, ya / 3.0::DOUBLE) + greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN colour THEN dropped / 0.5::DOUBLE ELSE shift / 0.6::DOUBLE END))) / 4, 3) AS score,
  CASE WHEN to_class = 'water' OR from_class = 'water' THEN 'water-extent' WHEN to_class = 'built' THEN CASE WHEN strip THEN 'road-development' ELSE 'construction' END WHEN from_class = 'vegetation' AND to_class = 'soil' THEN 'clearance' ELSE 'other' END AS change_class,
  CASE WHEN to_class = 'water' THEN 'expansion' WHEN from_class = 'water' THEN 'contraction' WHEN to_class = 'built' OR to_class = 'vegetation' THEN 'appearance' ELSE 'disappearance' END AS direction
FROM g""")
def group_gates_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, score and class of change events; here the tiles of a block are one event."""
    where = looks(spark, sf_dir).select(*KEYS, "block", "col").distinct().withColumn("row", F.lit(0))
    dated = change.refined(looks(spark, sf_dir), _transitions(spark, sf_dir), KEYS).join(where, list(KEYS))
    gated = change.gates(change.events(dated, ("block", "from_class", "to_class")))
    named = gated.withColumn("kind", change.change_class(F.col("from_class"), F.col("to_class"), F.col("elongated")))
    names = ("quality", "geometry", "radiometric", "season", "size", "persistence")
    return named.select(
        "block", "from_class", "to_class", "tiles", "masked", F.size("satellites").cast("bigint").alias("satellites"), "area_min_m2", F.col("earliest_supported_after").alias("first_after"), F.col("last_clean_before").alias("last_before"), "elongated",
        *[F.col("gates")[i]["passed"].alias(n) for i, n in enumerate(names)], "accepted", "score", F.col("kind.class").alias("change_class"), F.col("kind.direction").alias("direction"),
    )


@query()
def change_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine end to end; groups grow in an order that SQL has no word for."""
    seen = looks(spark, sf_dir).withColumn("tile_id", F.concat_ws(":", "aoi", "row", "col"))
    ring = F.expr("array(array(array(col * 1D, row * 1D), array(col + 1D, row * 1D), array(col + 1D, row + 1D), array(col * 1D, row + 1D), array(col * 1D, row * 1D)))")
    square = F.to_json(F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")))
    tiles = seen.select("aoi", "tile_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct().withColumns({"lon": F.col("col") + 0.5, "lat": F.col("row") + 0.5, "geometry": square})
    return change.candidates(seen.drop("row", "col", "block"), tiles)


@query("SELECT l_suppkey AS id, count(*) FILTER (WHERE l_returnflag = 'N') AS hits, count(*) AS clear FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'N') / count(*) >= 0.33")
def persistent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose looks bear a label in 33 % of them at least: some do, some do not."""
    return change.persistent_share(table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_suppkey")), "id", F.col("l_returnflag") == "N", 0.33)


@query("SELECT l_partkey AS id, count(*) FILTER (WHERE l_discount < 0.05) AS hits, count(*) AS clear FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (WHERE l_discount < 0.05) / count(*) >= 0.5")
def persistent_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are water in half of their looks at least: some are, some are not."""
    return change.persistent_share(table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey")), "id", F.col("l_discount") < 0.05, 0.5)
