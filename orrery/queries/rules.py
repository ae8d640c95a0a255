"""Operators that the other queries leave out, over the driver's tables; the SQL states their rules by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import geo, rules, text, vector
from orrery.operators import change, clusters, governance, imagery, ingest, merge, raster, spatial, vectors
from orrery.plans import engine
from orrery.plans.parser import Context, parse
from orrery.queries.base import EVENTS_SQL, events, haversine_sql, iso, lat_of, lat_sql, lon_of, lon_sql, query, table
from orrery.queries.observations import HOLE, TRIANGLE, crossings_sql
from orrery.sources import feeds
from orrery.streaming import observations as streaming

COUNTRY = [[TRIANGLE, HOLE]]


def _inside(x: str, y: str) -> str:
    return f"({crossings_sql(x, y, TRIANGLE)} % 2 = 1 AND {crossings_sql(x, y, HOLE)} % 2 = 0)"


@query(f"""WITH o AS (SELECT o_orderkey AS k, {lon_sql("o_orderkey")} AS x, CASE WHEN o_orderkey % 97 = 0 THEN 95.0 WHEN o_orderkey % 89 = 0 THEN NULL ELSE {lat_sql("o_orderkey")} END AS y,
  CASE WHEN o_orderkey % 83 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'Port of Triangland' ELSE 'Order' END AS title, CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_orderdate END AS t, o_orderkey % 13 = 0 AS national FROM orders),
r AS (SELECT *, CASE WHEN NOT national AND y IS NULL THEN 'missing geometry' WHEN NOT national AND abs(y) > 90 THEN 'coordinate out of range' WHEN trim(title) = '' THEN 'missing title' WHEN t IS NULL THEN 'missing time' END AS reason FROM o),
d AS (SELECT CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN national THEN 'kept' WHEN {_inside("x", "y")} THEN 'kept' WHEN {_inside("y", "x")} AND contains(lower(title), 'triangland') THEN 'suspect-swap' ELSE 'outside' END AS disposition, reason FROM r)
SELECT disposition, reason, count(*) AS n FROM d GROUP BY ALL""")
def ingest_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records validated and held against a country's polygon, with the counters of the run."""
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(
        lon_of(k).alias("lon"),
        F.when(k % 97 == 0, F.lit(95.0)).when(k % 89 == 0, F.lit(None).cast("double")).otherwise(lat_of(k)).alias("lat"),
        F.when(k % 83 == 0, " ").when(k % 3 == 0, "Port of Triangland").otherwise("Order").alias("title"),
        F.when(k % 79 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start_time"),
        F.when(k % 13 == 0, "national").otherwise("spatial").alias("scope"),
    )
    return ingest.counters(ingest.judged(records, COUNTRY, "Triangland"))


@query("""WITH n AS (SELECT event_id AS id, user_id % 50 AS record, value, event_id AS seq FROM events),
last AS (SELECT record, arg_max(value, seq) AS value FROM n GROUP BY record)
SELECT 's:' || record AS id, round(value, 6) AS value FROM last""")
def ingest_last_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that holds a record many times: the last one counts."""
    batch = table(spark, sf_dir, "events").select(F.lit("s").alias("source_id"), (F.col("user_id") % 50).cast("string").alias("record_id"), "value", "event_id", F.lit("kept").alias("disposition"), F.lit(None).cast("string").alias("reason"))
    ordered = batch.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id")
    old = spark.createDataFrame([], "source_id string, value double, id string, created_at string, updated_at string")
    return ingest.stored(old, ordered, "now").select("id", F.round("value", 6).alias("value"))


PLACES = Context(capabilities={"change-detection": {"name": "Change detection", "status": "NOT STAGED", "fallback": "rules"}}, places=(("centre", {"name": "Centre", "kind": "city", "lon": 82.0, "lat": 21.0, "population": 1}),))
KINDS = {"purchase": "earthquake", "view": "flood", "click": "landslide", "signup": "drought", "error": "launch"}
KIND_SQL = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def _asked(spark: SparkSession, sf_dir: str, question: str, **tables: DataFrame) -> DataFrame:
    live = {s: "LIVE" for sources in (*engine.v.EVENT_SOURCES.values(), *engine.v.ENTITY_SOURCES.values()) for s in sources}
    return engine.run(parse(question, context=PLACES), tables, live, {"scenes": 1})["rows"]


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT id, {KIND_SQL} AS kind, start_time, {haversine_sql("lon", "lat", "82.0", "21.0")} AS d, coalesce(CAST(attributes ->> '$.k' AS DOUBLE), 0.0) AS m, lon, lat FROM e)
SELECT id, kind AS type, round(d, 3) AS distance_m FROM q WHERE kind = 'earthquake' AND start_time >= '2024-01-01T00:00:00Z' AND m >= 5 AND d <= 600000 ORDER BY d, start_time DESC, id LIMIT 200""")
def question_about_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that is read, found answerable and run: events near a place, since a year, above a magnitude."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    e = events(spark, sf_dir).withColumn("type", F.element_at(kinds, F.col("type"))).withColumn("attributes", F.to_json(F.struct(F.get_json_object("attributes", "$.k").try_cast("double").alias("magnitude"))))
    rows = _asked(spark, sf_dir, "Show earthquakes magnitude 5 and above within 600 km of Centre since 2024", events=e)
    return rows.select("id", "type", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH p AS (SELECT s_suppkey AS id, s_name AS name, {haversine_sql(lon_sql("s_suppkey"), lat_sql("s_suppkey"), "82.0", "21.0")} AS d FROM supplier)
SELECT id, name, round(d, 3) AS distance_m FROM p WHERE d <= 400000 ORDER BY d, name, id LIMIT 200""")
def question_about_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports within a distance of a place, nearest first."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("port").alias("type"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    return _asked(spark, sf_dir, "ports within 400 km of Centre", entities=s).select("id", "name", F.round("distance_m", 3).alias("distance_m"))


CHANGE_KINDS = ("construction", "clearance", "water-extent", "road-development")


@query(f"""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(CHANGE_KINDS))} END AS class, CASE WHEN o_orderkey % 3 = 0 THEN 'expansion' ELSE 'contraction' END AS direction,
  o_totalprice AS score, o_orderstatus <> 'P' AS accepted, strftime(o_orderdate, '%Y-%m-%d') AS earliest_after FROM orders)
SELECT id, class, direction, score FROM c WHERE accepted AND class = 'water-extent' AND direction = 'expansion' AND earliest_after >= '1997-01-01T00:00:00Z' ORDER BY score DESC, id LIMIT 100""")
def question_about_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted changes of one class and direction since a year, by score."""
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, CHANGE_KINDS)), (k % 4 + 1).cast("int")).alias("class"), F.when(k % 3 == 0, "expansion").otherwise("contraction").alias("direction"),
        F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") != "P").alias("accepted"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("earliest_after"), lon_of(k).alias("lon"), lat_of(k).alias("lat"),
    )
    return _asked(spark, sf_dir, "water expansion since 1997", changes=c).select("id", "class", "direction", "score")


@query("""WITH s AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS t, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 7) AS month, o_orderkey % 3 = 0 AS covers, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS cloud, o_orderkey % 5 AS version FROM orders),
held AS (SELECT DISTINCT month FROM s WHERE id % 400 = 0)
SELECT month, id, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY covers DESC, cloud ASC NULLS LAST, version DESC, id) AS r FROM s WHERE month NOT IN (SELECT month FROM held)) WHERE r <= 3""")
def scenes_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scenes of the months that hold none yet."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("acquired_at"), (k % 3 == 0).alias("covers"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("cloud"), (k % 5).alias("version"))
    return imagery.best_of_month(s, s.where("id % 400 = 0")).select("month", "id", "rank")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN q NOT IN ('usable', 'degraded') OR q IS NULL THEN 'quality is ' || coalesce(q, 'unknown') WHEN f IS NULL THEN 'file missing' WHEN o IS NULL THEN 'offset unknown' END AS reason
  FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'rejected' END AS q, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS f, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS o FROM part)) GROUP BY reason""")
def scenes_ineligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    quality = F.when(k % 4 == 0, "usable").when(k % 4 == 1, "degraded").when(k % 4 == 2, "rejected")
    s = table(spark, sf_dir, "part").select(quality.alias("quality_status"), F.when(k % 5 > 0, F.col("p_name")).alias("file"), F.when(k % 3 > 0, F.col("p_size")).alias("offset"))
    return imagery.ineligible(s).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT event_type AS layer, user_id AS source_id FROM events GROUP BY ALL), s AS (SELECT user_id AS source_id, CASE user_id % 5 WHEN 0 THEN 'STALE' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'SNAPSHOT' WHEN 3 THEN 'DELAYED' ELSE 'KEY REQUIRED' END AS state,
  max(strftime(ts, '%Y-%m-%d')) AS updated, count(*) AS n FROM events WHERE user_id % 6 > 0 GROUP BY user_id)
SELECT layer, arg_min(state, CASE state WHEN 'DELAYED' THEN 2 WHEN 'SNAPSHOT' THEN 3 WHEN 'STALE' THEN 4 WHEN 'UNAVAILABLE' THEN 5 WHEN 'KEY REQUIRED' THEN 7 END) AS state, max(updated) AS updated, coalesce(sum(n), 0)::BIGINT AS n FROM l LEFT JOIN s USING (source_id) GROUP BY layer""")
def layers_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best state, newest update and records of each layer's sources."""
    e, k = table(spark, sf_dir, "events"), F.col("source_id")
    layers = e.select(F.col("event_type").alias("layer"), F.col("user_id").alias("source_id")).distinct()
    state = F.when(k % 5 == 0, "STALE").when(k % 5 == 1, "UNAVAILABLE").when(k % 5 == 2, "SNAPSHOT").when(k % 5 == 3, "DELAYED").otherwise("KEY REQUIRED")
    sources = e.where("user_id % 6 > 0").groupBy(F.col("user_id").alias("source_id")).agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("updated"), F.count(F.lit(1)).alias("n")).withColumn("state", state)
    return imagery.layer_states(layers, sources)


@query("""WITH m AS (SELECT s_suppkey % 6 AS eligible, s_suppkey % 4 AS indexed, s_suppkey % 5 > 0 AS model, s_suppkey % 7 = 0 AS running FROM supplier)
SELECT CASE WHEN NOT model OR eligible = 0 THEN 'NOT STAGED' WHEN running THEN 'INDEXING' WHEN indexed = 0 THEN 'NOT STAGED' WHEN indexed < eligible THEN 'PARTIAL' ELSE 'READY' END AS state, count(*) AS n FROM m GROUP BY ALL""")
def retrieval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(imagery.retrieval_state(k % 5 > 0, k % 6, k % 4, k % 7 == 0).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_partkey AS scene_id, 200 + p_partkey % 700 AS h, 180 + p_partkey % 500 AS w FROM part), z(px) AS (VALUES (224), (112)),
r AS (SELECT scene_id, px, h, w, ceil(h / px::DOUBLE)::INTEGER AS nr, ceil(w / px::DOUBLE)::INTEGER AS nc FROM s, z WHERE h >= px AND w >= px),
a AS (SELECT *, unnest(range(nr)) AS i FROM r), b AS (SELECT *, unnest(range(nc)) AS j FROM a)
SELECT scene_id, px AS chip_px, CASE WHEN nr > 1 THEN round_even(i * (h - px)::DOUBLE / (nr - 1), 0) ELSE 0 END::INTEGER AS row_off, CASE WHEN nc > 1 THEN round_even(j * (w - px)::DOUBLE / (nc - 1), 0) ELSE 0 END::INTEGER AS col_off FROM b""")
def chips_of_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of both sizes that cover each scene from edge to edge."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("id"), (200 + k % 700).cast("int").alias("height"), (180 + k % 500).cast("int").alias("width"))
    return imagery.chip_windows(s)


@query("""WITH a AS (SELECT l_partkey % 300 AS r, l_suppkey % 300 AS c, CASE WHEN l_linenumber % 2 = 0 THEN 224 ELSE 112 END AS px, l_quantity::INTEGER AS d, l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(r + px, r + d + 112) - greatest(r, r + d)) * greatest(0, least(c + px, c + 2 * d + 112) - greatest(c, c + 2 * d)) / (112.0 * 112.0), 6)::DOUBLE AS overlap FROM a""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, px = F.col("l_quantity").cast("int"), F.when(F.col("l_linenumber") % 2 == 0, 224).otherwise(112)
    r, c = (F.col("l_partkey") % 300).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.overlap_share(r, c, px, r + d, c + 2 * d, F.lit(112)), 6).alias("overlap"))


@query("""SELECT c_custkey AS id, true AS old FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0""")
def rows_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not there yet, once each, beside those that are."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    new = c.where("id % 2 = 0").withColumn("old", F.lit(False))
    return merge.inserted(c.where("id % 3 = 0").withColumn("old", F.lit(True)), new.union(new), ["id"])


@query("""SELECT o_orderkey AS id, o_orderstatus AS state, 1 AS run FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, 2 FROM orders WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'F')""")
def rerun_keeps_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run replaces what nobody reviewed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return merge.rerun_kept(o.where("id % 2 = 0").withColumn("run", F.lit(1)), o.where("id % 3 = 0").withColumn("run", F.lit(2)), F.col("state") == "F")


@query("""SELECT p_partkey AS id, p_name AS name, 0 AS changed FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, upper(p_name), 1 FROM part WHERE p_partkey % 4 = 0""")
def rows_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(0).alias("changed"))
    return merge.replaced_rows(p, p.where("id % 4 = 0").withColumns({"name": F.upper("name"), "changed": F.lit(1)}))


@query("""SELECT o_custkey AS source_id, strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS stamp FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey DESC) <= 3""")
def snapshots_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("stamp"))
    return merge.retained(s, 3)


@query("""SELECT r_regionkey AS v, CASE WHEN r_regionkey % 2 = 0 THEN 'superseded' ELSE 'failed' END AS status FROM region UNION ALL SELECT 99, 'current'""")
def versions_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("v"), F.when(F.col("r_regionkey") % 2 == 0, "current").otherwise("failed").alias("status"))
    return merge.superseded(v, spark.createDataFrame([(99, "")], "v int, status string"))


@query("""SELECT o_orderkey AS id, l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1000 ELSE 1 END AS metres, CASE WHEN l_linenumber % 3 = 0 THEN round(l_tax * 100) END::DOUBLE AS magnitude
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def numbers_in_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and magnitudes, read back from sentences."""
    even, third = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 3 == 0
    said = F.concat(F.lit("show quakes "), F.when(third, F.format_string("magnitude %d ", F.round(F.col("l_tax") * 100).cast("int"))).otherwise(""), F.format_string("within %.1f ", "l_quantity"), F.when(even, "km").otherwise("m"), F.lit(" of here"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), said.alias("said"))
    return rows.select("id", text.distance_m(F.col("said")).alias("metres"), text.min_magnitude(F.col("said")).alias("magnitude"))


CHANGE_WORDS = "CASE WHEN regexp_matches(t, '\\bconstruct\\w*\\b|\\bnew\\s+buildings?\\b') THEN 'construction' WHEN regexp_matches(t, '\\bnew\\s+roads?\\b') THEN 'road-development' WHEN regexp_matches(t, '\\bclear(ed|ing|ance)\\b') THEN 'clearance' END"
PHRASES = ("construction of a dam", "new roads and new buildings", "clearing by new roads", "new roads", "a clearance", "nothing")


@query(f"""WITH p AS (SELECT p_partkey AS id, list_extract({list(PHRASES)!r}, (p_partkey % {len(PHRASES)} + 1)::INTEGER) AS t FROM part) SELECT id, {CHANGE_WORDS} AS class FROM p""")
def planner_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's own words for changes: the first entry of its table decides, not the first word."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int")).alias("t"))
    return p.select("id", text.first_match(F.col("t"), [(pattern, value[0]) for pattern, value in engine.v.CHANGES]).alias("class"))


@query("""SELECT s_suppkey AS id, 'a:b' AS aoi, s_suppkey % 40 AS row, s_suppkey // 40 AS col, 'src:' || s_suppkey AS record, CASE WHEN s_suppkey % 2 = 0 THEN 'S2A' ELSE 'S2B' END AS satellite FROM supplier""")
def ids_taken_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record and tile ids, built and parsed from the right; the satellite of a scene."""
    k = F.col("s_suppkey")
    tile = text.tile_parts(F.concat_ws(":", F.lit("a:b"), (k % 40).cast("string"), F.expr("cast(s_suppkey div 40 as string)")))
    scene = F.concat(F.when(k % 2 == 0, "S2A").otherwise("S2B"), F.lit("_43QBB_20240101_0_L2A"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), tile["aoi"].alias("aoi"), tile["row"].cast("bigint").alias("row"), tile["col"].cast("bigint").alias("col"), text.record_key(F.lit("src"), k.cast("string")).alias("record"), text.satellite(scene).alias("satellite"))


def _fixed_sql(x: str, digits: int, even: bool = False) -> str:
    """Rounded by the digits of the double's whole expansion."""
    said = f"printf('%.70f', {x})"
    kept, rest = f"left({said}, instr({said}, '.') + {digits})", f"substr({said}, instr({said}, '.') + {digits + 1})"
    number = f"CAST(replace({kept}, '.', '') AS BIGINT)"
    tie = f"(rtrim({rest}, '0') = '5' AND {number} % 2 = 0)" if even else "false"
    up = f"({number} + CASE WHEN left({rest}, 1) >= '5' AND NOT {tie} THEN 1 ELSE 0 END)"
    return f"({up} // {10**digits} || '.' || lpad(({up} % {10**digits})::VARCHAR, {digits}, '0'))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey * p_partkey * 7 AS n, p_partkey * 3 AS m, p_partkey / 3.0::DOUBLE + 0.01::DOUBLE AS h FROM part),
x AS (SELECT *, n / 1024::DOUBLE AS kb, n / 1048576::DOUBLE AS mb, n / 1073741824::DOUBLE AS gb, m / 1000::DOUBLE AS km, m / 10000::DOUBLE AS ha, h / 24 AS days FROM p)
SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {_fixed_sql("kb", 1)} || ' KB' WHEN n < 1073741824 THEN {_fixed_sql("mb", 1)} || ' MB' ELSE {_fixed_sql("gb", 2)} || ' GB' END AS size,
  CASE WHEN m < 1000 THEN m || ' m' ELSE {_fixed_sql("km", 1)} || ' km' END AS distance, CASE WHEN h < 1 THEN greatest(1, round_even(h * 60, 0)::INTEGER) || ' min' WHEN h < 48 THEN {_fixed_sql("h", 1, True)} || ' h' ELSE {_fixed_sql("days", 1, True)} || ' d' END AS age,
  {_fixed_sql("ha", 1)} || ' ha' AS area FROM x""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, metres, hours and square metres as people read them."""
    k = F.col("p_partkey").cast("bigint")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (k * k * 7).alias("n"), (k * 3).alias("m"), (k / 3.0 + 0.01).alias("h"))
    return p.select("id", text.human_bytes(F.col("n")).alias("size"), text.human_distance(F.col("m").cast("double")).alias("distance"), text.human_age(F.col("h")).alias("age"), text.human_area(F.col("m").cast("double")).alias("area"))


@query(f"""SELECT s_suppkey AS id, printf('%.4f° ', abs({lat_sql("s_suppkey")} - 20)) || CASE WHEN {lat_sql("s_suppkey")} - 20 < 0 THEN 'S' ELSE 'N' END || ' ' || printf('%.4f° ', abs({lon_sql("s_suppkey")} - 80)) || CASE WHEN {lon_sql("s_suppkey")} - 80 < 0 THEN 'W' ELSE 'E' END AS at,
  lpad(((s_suppkey * 37 % 360 - 180 + 360) % 360)::VARCHAR, 3, '0') || '°' AS bearing FROM supplier""")
def positions_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.latlon_text(lon_of(k) - 80, lat_of(k) - 20).alias("at"), text.bearing_text((k * 37 % 360 - 180).cast("double")).alias("bearing"))


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS zoned FROM events""")
def times_as_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds and zoned texts as ISO UTC."""
    e = table(spark, sf_dir, "events")
    there = F.concat(F.date_format(F.col("ts") + F.expr("interval 5 hours 30 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return e.select(F.col("event_id").alias("id"), feeds.iso_seconds(F.unix_timestamp(F.date_trunc("second", "ts"))).alias("iso"), feeds.iso_text(there).alias("zoned"))


PIXEL_SQL = """px AS (SELECT l_suppkey AS scene_id, (l_orderkey % 20)::INTEGER AS row, (l_partkey % 20)::INTEGER AS col, l_tax AS b02, l_tax + 0.02 AS b03, l_discount AS b04, l_quantity / 100 AS b08, l_discount / 2 + 0.01 AS b11, l_linenumber AS scl FROM lineitem),
k AS (SELECT *, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS valid, CASE WHEN b08 + b04 <> 0 THEN (b08 - b04) / (b08 + b04) ELSE 0 END AS ndvi, CASE WHEN b03 + b11 <> 0 THEN (b03 - b11) / (b03 + b11) ELSE 0 END AS mndwi FROM px),
c AS (SELECT *, CASE WHEN NOT valid THEN NULL WHEN mndwi > 0.1 AND ndvi < 0.2 THEN 'water' WHEN ndvi >= 0.35 THEN 'vegetation' ELSE 'open' END AS kind FROM k)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"), (F.col("l_orderkey") % 20).cast("int").alias("row"), (F.col("l_partkey") % 20).cast("int").alias("col"), F.col("l_tax").alias("b02"), (F.col("l_tax") + 0.02).alias("b03"),
        F.col("l_discount").alias("b04"), (F.col("l_quantity") / 100).alias("b08"), (F.col("l_discount") / 2 + 0.01).alias("b11"), F.col("l_linenumber").alias("scl"),
    )


@query(f"""WITH {PIXEL_SQL} SELECT scene_id, row // 10 AS tile_row, col // 10 AS tile_col, round(avg(valid::INT), 9) AS valid_fraction, round(count(*) FILTER (WHERE kind = 'water')::DOUBLE / count(*) FILTER (WHERE valid), 9) AS water,
  round(count(*) FILTER (WHERE kind = 'vegetation')::DOUBLE / count(*) FILTER (WHERE valid), 9) AS vegetation, round(avg(b04) FILTER (WHERE valid), 6) AS b04_mean, round(avg(ndvi) FILTER (WHERE valid), 6) AS ndvi_mean,
  round(stddev_pop((b02 + b03 + b04) / 3) FILTER (WHERE valid), 6) AS texture FROM c GROUP BY ALL""")
def tiles_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares, means and texture of each tile."""
    t = raster.tile_summaries(_pixels(spark, sf_dir), 20, 20)
    r = lambda c, n: F.round(c, n).alias(c)
    return t.select("scene_id", "tile_row", "tile_col", r("valid_fraction", 9), r("water", 9), r("vegetation", 9), r("b04_mean", 6), r("ndvi_mean", 6), r("texture", 6))


@query(f"""WITH {PIXEL_SQL}, q AS (SELECT scene_id, avg(valid::INT) AS v FROM c GROUP BY ALL), d AS (SELECT scene_id, count(*) AS n, quantile_cont(b02, 0.01) AS p1 FROM c WHERE valid AND b02 > 0 GROUP BY ALL)
SELECT q.scene_id, round(v, 9) AS valid_fraction, CASE WHEN v >= 0.9 THEN 'usable' WHEN v >= 0.6 THEN 'degraded' ELSE 'rejected' END AS quality_status, n, CASE WHEN n >= 100 THEN round(p1, 9) END AS p1 FROM q LEFT JOIN d USING (scene_id)""")
def scenes_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear share, status and darkest percentile of each scene."""
    p = _pixels(spark, sf_dir)
    joined = raster.scene_quality(p).join(raster.dark_pixels(p), "scene_id", "left")
    return joined.select("scene_id", F.round("valid_fraction", 9).alias("valid_fraction"), "quality_status", "n", F.round("p1", 9).alias("p1"))


BASELINES = ("04.00", "03.01", "01.50", "unknown", "05.11")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size, list_extract({list(BASELINES)!r}, (p_partkey % 5 + 1)::INTEGER) AS base, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS applied FROM part),
o AS (SELECT *, CASE WHEN try_cast(base AS DOUBLE) IS NULL OR try_cast(base AS DOUBLE) < 2 THEN NULL WHEN try_cast(base AS DOUBLE) < 4 THEN 0.0 WHEN applied THEN 0.0 WHEN NOT applied THEN -0.1 END::DOUBLE AS off FROM p)
SELECT id, off, round(p_size * 0.0001 + off, 9)::DOUBLE AS reflectance, least(255, greatest(0, trunc(p_size / 100.0 / 0.3 * 255)))::INTEGER AS stretched FROM o""")
def reflectance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets by baseline and flag, scaling, and the stretch of a picture."""
    k = F.col("p_partkey")
    off = rules.offset_of(F.element_at(F.array(*map(F.lit, BASELINES)), (k % 5 + 1).cast("int")), F.when(k % 3 == 0, True).when(k % 3 == 1, False))
    return table(spark, sf_dir, "part").select(k.alias("id"), off.alias("off"), F.round(rules.reflectance(F.col("p_size"), off), 9).alias("reflectance"), rules.stretched(F.col("p_size") / 100).alias("stretched"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS v, l_discount * 8 AS w, l_tax * 8 AS g, l_extendedprice / 500000 AS b, l_discount / 2 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v < 0.8 THEN NULL WHEN w >= 0.5 THEN 'water' WHEN g >= 0.5 THEN 'vegetation' WHEN 1 - w - g >= 0.5 AND (b >= 0.16 OR x >= 0.035) THEN 'built' WHEN 1 - w - g >= 0.5 THEN 'bare' ELSE 'mixed' END AS class FROM t""")
def tile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a tile in one look, by its shares, brightness and texture."""
    w, g = F.col("l_discount") * 8, F.col("l_tax") * 8
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.tile_class(F.col("l_quantity") / 50, w, g, 1 - w - g, F.col("l_extendedprice") / 500_000, F.col("l_discount") / 2).alias("class"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '03.01' WHEN 1 THEN '04.00' WHEN 2 THEN '05.00' END AS base, p_partkey % 8 > 4 AS applied, p_partkey % 200 AS n, p_size * 30.0 AS p1, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE -0.1 END AS stored FROM part),
o AS (SELECT *, CASE WHEN base IS NULL THEN NULL WHEN base < '04' THEN 0.0 WHEN applied THEN 0.0 ELSE -0.1 END AS told FROM s)
SELECT id, CASE WHEN told IS NULL OR (n >= 100 AND p1 < 600 AND told <> 0) OR (n >= 100 AND p1 > 1000 AND told = 0) THEN 'quarantined' WHEN told = stored THEN 'ok' ELSE 'corrected' END AS state FROM o""")
def radiometry_rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets derived anew from tags and held against the darkest pixels."""
    k = F.col("p_partkey")
    base = F.when(k % 4 == 0, "03.01").when(k % 4 == 1, "04.00").when(k % 4 == 2, "05.00")
    s = table(spark, sf_dir, "part").select(k.alias("id"), base.alias("baseline"), (k % 8 > 4).alias("applied"), (k % 200).alias("n_clear"), (F.col("p_size") * 30.0).alias("p1"), F.when(k % 2 == 0, 0.0).otherwise(-0.1).alias("offset"))
    return imagery.radiometry_rechecked(s).select("id", "state")


@query("""WITH r AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey AS id FROM orders), j AS (SELECT o_custkey AS q, o_orderkey AS id, o_orderstatus = 'F' AS rel FROM orders WHERE o_orderkey % 3 > 0),
l AS (SELECT c_custkey AS q, c_custkey % 4 > 0 AS ver, c_custkey % 2 = 0 AS ex FROM customer), n AS (SELECT q, count(*) AS judged, count(*) FILTER (WHERE rel) AS relevant FROM j GROUP BY q),
x AS (SELECT r.q, r.rank, j.rel, coalesce(j.rel, false) AS hit, sum(coalesce(j.rel, false)::INT) OVER (PARTITION BY r.q ORDER BY r.rank) AS hits FROM r LEFT JOIN j USING (q, id)),
s AS (SELECT q, count(*) FILTER (WHERE rank <= 5 AND hit) AS h5, count(*) FILTER (WHERE rank <= 5 AND rel IS NULL) AS u5, sum(hits / rank) FILTER (WHERE hit) AS gain, count(*) FILTER (WHERE hit) AS found FROM x GROUP BY q)
SELECT l.q AS query, CASE WHEN ver AND judged > 0 THEN 'MEASURED' ELSE 'NOT AVAILABLE' END AS status, round(CASE WHEN ver AND judged > 0 THEN coalesce(h5, 0) / 5.0 END::DOUBLE, 6) AS precision_at_5, round(CASE WHEN ver AND ex AND relevant > 0 THEN coalesce(h5, 0) / relevant END::DOUBLE, 6) AS recall_at_5,
  CASE WHEN ver AND judged > 0 THEN coalesce(u5, 0) END AS unjudged_at_5, round(CASE WHEN ver AND judged > 0 AND CASE WHEN ex THEN relevant ELSE found END > 0 THEN coalesce(gain, 0) / CASE WHEN ex THEN relevant ELSE found END END::DOUBLE, 6) AS average_precision
FROM l LEFT JOIN n USING (q) LEFT JOIN s USING (q)""")
def rankings_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of rankings that have verified judgements, and NOT AVAILABLE for the others."""
    from pyspark.sql import Window

    from orrery.operators import evaluation

    o = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = o.select(F.col("o_custkey").alias("query"), F.row_number().over(order).alias("rank"), F.col("o_orderkey").alias("id"))
    judged = o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("relevant"))
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), (F.col("c_custkey") % 4 > 0).alias("verified"), (F.col("c_custkey") % 2 == 0).alias("exhaustive"))
    m = evaluation.ranking_metrics(ranked, judged, labels, (5,))
    return m.select("query", "status", *[F.round(c, 6).alias(c) for c in ("precision_at_5", "recall_at_5")], "unjudged_at_5", F.round("average_precision", 6).alias("average_precision"))


@query("""WITH p AS (SELECT l_suppkey AS pair, l_orderkey AS r, l_linenumber AS c, CASE WHEN max(l_discount) > 0.08 THEN 255 WHEN max(l_discount) > 0.04 THEN 1 ELSE 0 END AS p, CASE WHEN max(l_tax) > 0.07 THEN 255 WHEN max(l_tax) > 0.03 THEN 1 ELSE 0 END AS t FROM lineitem GROUP BY ALL),
k AS (SELECT pair, count(*) FILTER (WHERE p = 1 AND t = 1) AS tp, count(*) FILTER (WHERE p = 1 AND t = 0) AS fp, count(*) FILTER (WHERE p = 0 AND t = 1) AS fn, count(*) FILTER (WHERE p = 0 AND t = 0) AS tn FROM p WHERE p <> 255 AND t <> 255 GROUP BY pair),
s AS (SELECT s_suppkey AS pair, s_suppkey % 3 > 0 AS ver, s_suppkey % 5 > 0 AS grid FROM supplier)
SELECT pair, CASE WHEN NOT ver THEN 'NOT AVAILABLE: no verified mask' WHEN NOT grid THEN 'NOT AVAILABLE: another grid' ELSE 'MEASURED' END AS status, CASE WHEN ver AND grid THEN tp END AS tp, CASE WHEN ver AND grid THEN fn END AS fn, round(CASE WHEN ver AND grid THEN 2 * tp / (2 * tp + fp + fn) END::DOUBLE, 6) AS f1, round(CASE WHEN ver AND grid THEN tp / (tp + fp + fn) END::DOUBLE, 6) AS iou FROM s LEFT JOIN k USING (pair)""")
def masks_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change masks against verified ones, pixel by pixel."""
    from orrery.operators import evaluation

    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    mask = lambda c, void, yes: line.select("pair", "row", "col", F.when(F.col(c) > void, 255).when(F.col(c) > yes, 1).otherwise(0).alias("value"))
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair"), (F.col("s_suppkey") % 3 > 0).alias("verified"), (F.col("s_suppkey") % 5 > 0).alias("grid_equal"))
    m = evaluation.mask_metrics(mask("d", 0.08, 0.04), mask("t", 0.07, 0.03), pairs)
    return m.select("pair", "status", "tp", "fn", F.round("f1", 6).alias("f1"), F.round("iou", 6).alias("iou"))


STRUCTURE_SQL = """m AS (SELECT vec_id AS id, label AS cluster, vec_id % 40 AS place, vec_id % 7 AS scene_id, 1 + vec_id % 12 AS month, embedding::DOUBLE[] AS e FROM embeddings)"""


def _structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("vec_id")
    date = F.concat(F.lit("2024-"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-01"))
    m = table(spark, sf_dir, "embeddings").select(F.lit(64).alias("family"), k.alias("id"), F.col("label").alias("cluster"), (k % 40).alias("place"), (k % 7).alias("scene_id"), date.alias("acquired_at"), "embedding")
    return clusters.structure(m)


@query(f"""WITH {STRUCTURE_SQL}, n AS (SELECT count(*) AS n FROM m), pp AS (SELECT place, max(k) / sum(k) AS a FROM (SELECT place, cluster, count(*) AS k FROM m GROUP BY ALL) GROUP BY place), cs AS (SELECT cluster, count(*) AS k FROM m GROUP BY cluster),
s AS (SELECT a.id AS q, (a.cluster = b.cluster)::INT AS same, a.place = b.place AS here, list_inner_product(a.e, b.e) AS v, b.id FROM m a JOIN m b ON a.id <> b.id),
x AS (SELECT q, avg(same) AS v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, id) AS r FROM s) WHERE r <= 10 GROUP BY q), y AS (SELECT q, avg(same) AS v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, id) AS r FROM s WHERE NOT here) WHERE r <= 10 GROUP BY q)
SELECT 64 AS family, (SELECT n FROM n) AS chips, (SELECT count(DISTINCT place) FROM m) AS places, (SELECT count(*) FROM cs) AS clusters, round((SELECT avg(a) FROM pp), 6) AS consistency, round((SELECT avg(v) FROM x), 6) AS nearest_same, round((SELECT avg(v) FROM y), 6) AS elsewhere_same, round((SELECT sum((k / n) ** 2) FROM cs, n), 6) AS chance""")
def clustering_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be measured of a clustering without labels."""
    f, _ = _structure(spark, sf_dir)
    r = lambda c, n: F.round(c, 6).alias(n)
    return f.select("family", "chips", "places", "clusters", r("cross_date_consistency", "consistency"), r("nearest_same", "nearest_same"), r("nearest_elsewhere_same", "elsewhere_same"), r("chance_same", "chance"))


@query(f"""WITH {STRUCTURE_SQL}, a AS (SELECT scene_id, count(*) AS n FROM m GROUP BY ALL), sc AS (SELECT cluster, scene_id, count(*) AS k FROM m GROUP BY ALL), cov AS (SELECT cluster, avg(k / n) AS c FROM sc JOIN a USING (scene_id) GROUP BY cluster), tp AS (SELECT cluster, max(k) AS k FROM (SELECT cluster, place, count(*) AS k FROM m GROUP BY ALL) GROUP BY cluster)
SELECT m.cluster, count(*) AS size, count(DISTINCT place) AS places, round(any_value(c), 6) AS date_coverage, round(avg((month >= 10)::INT), 6) AS late_share, round(any_value(tp.k) / count(*), 6) AS top_place_share FROM m JOIN cov USING (cluster) JOIN tp USING (cluster) GROUP BY m.cluster""")
def clusters_by_date_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each cluster follows dates, seasons or single places."""
    _, c = _structure(spark, sf_dir)
    return c.select("cluster", "size", "places", *[F.round(x, 6).alias(x) for x in ("date_coverage", "late_share", "top_place_share")])


@query(f"""WITH b AS (SELECT c_custkey AS id, {lon_sql("c_custkey")} AS w, {lat_sql("c_custkey")} AS s, 0.5 + c_custkey % 3 AS dx, 0.25 + c_custkey % 2 AS dy FROM customer)
SELECT id, round(w, 6) AS west, round(s + dy, 6) AS north, round(w + dx / 2, 6) AS mid_x, round(s + dy / 2, 6) AS mid_y, round(dx * dy, 6)::DOUBLE AS area, round(2 * (dx + dy), 6)::DOUBLE AS length, round(dx * dy * 3 / 4, 6)::DOUBLE AS with_hole FROM b""")
def shapes_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, middle, area and length of rings, and the area of one with a hole of a quarter."""
    k = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(k.alias("id"), lon_of(k).alias("w"), lat_of(k).alias("s"), (0.5 + k % 3).alias("dx"), (0.25 + k % 2).alias("dy"))
    w, s, dx, dy = (F.col(c) for c in ("w", "s", "dx", "dy"))
    outer, hole = geo.box_ring(w, s, w + dx, s + dy), geo.box_ring(w + dx / 4, s + dy / 4, w + 3 * dx / 4, s + 3 * dy / 4)
    box, mid = geo.bbox_of(outer), geo.representative(outer)
    r = lambda c, n: F.round(c, 6).alias(n)
    return b.select("id", r(box["west"], "west"), r(box["north"], "north"), r(mid["x"], "mid_x"), r(mid["y"], "mid_y"), r(geo.ring_area(outer), "area"), r(geo.ring_length(outer), "length"), r(geo.polygon_area(F.array(outer, hole)), "with_hole"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT list_inner_product(embedding::DOUBLE[], v) AS s FROM embeddings, q)
SELECT round(median(s), 4) AS median, round(min(s), 4) AS least, round(max(s), 4) AS greatest, count(*) AS n FROM s""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, least and greatest similarity of all vectors to one."""
    e = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 7").first().embedding]
    d = vectors.distribution(e.select(vector.dot(vector.doubles(F.col("embedding")), vector.literal(q)).alias("score")))
    return d.select(*[F.round(c, 4).alias(c) for c in ("median", "least", "greatest")], "n")


MEMBERS_SQL = """m AS (SELECT l_suppkey % 20 AS cluster, l_partkey AS place, l_orderkey AS scene_id, l_linenumber AS aoi_id, strftime(l_shipdate, '%Y-%m-%d') AS t, l_extendedprice AS sim, l_orderkey * 10 + l_linenumber AS id, l_discount AS w, l_tax AS s FROM lineitem)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y")), F.struct((F.col("l_discount") + 1).alias("x"), (F.col("l_tax") + 2).alias("y")))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("cluster"), F.col("l_partkey").alias("place"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("aoi_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("acquired_at"),
        F.col("l_extendedprice").alias("sim"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ring.alias("footprint"),
    )


@query(f"""WITH {MEMBERS_SQL} SELECT cluster, count(*) AS size, count(DISTINCT place) AS places, count(DISTINCT scene_id) AS scenes, count(DISTINCT aoi_id) AS aois, round(min(w), 6) AS west, round(min(s), 6) AS south, round(max(w) + 1, 6) AS east, round(max(s) + 2, 6) AS north, min(t) AS first_date, max(t) AS last_date FROM m GROUP BY cluster""")
def clusters_summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, places, scenes, areas, extent and dates of each cluster."""
    return clusters.summaries(_members(spark, sf_dir), ["cluster"])


@query(f"""WITH {MEMBERS_SQL} SELECT cluster, place, count(*) AS n, arg_max(id, (sim, -id)) AS best, min(t) AS first_date, max(t) AS last_date FROM m GROUP BY ALL""")
def places_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster by place, with the most central one."""
    return clusters.by_place(_members(spark, sf_dir), ["cluster"], ["place"])


@query("""SELECT event_id AS id, event_type IN ('click', 'view') AND (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts))) / 3600.0 > 240 AS stale FROM events""")
def telemetry_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late telemetry is kept and flagged."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "ts")
    return streaming.flagged_stale(e, "2024-01-31 00:00:00", 240.0, ["click", "view"]).select("id", "stale")


@query("""WITH d AS (SELECT o_custkey AS target, max_by(o_orderstatus, o_orderkey) AS latest FROM orders GROUP BY ALL) SELECT c_custkey AS id, coalesce(latest, 'unreviewed') AS review_state FROM customer LEFT JOIN d ON c_custkey = target""")
def decisions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the state of their latest decision."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("unreviewed").alias("review_state"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target_id"), F.col("o_orderstatus").alias("decision"))
    return governance.decided(c, d)


@query("""SELECT s_suppkey AS id, 'chg-' || substr(sha256('a1|soil|water|a1:' || (s_suppkey % 7) || ':' || s_suppkey), 1, 12) AS candidate FROM supplier""")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.concat_ws(":", F.lit("a1"), (k % 7).cast("string"), k.cast("string"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), governance.candidate_id(F.lit("a1"), F.lit("soil"), F.lit("water"), first).alias("candidate"))


@query(f"""WITH c AS (SELECT c_custkey AS id, {lon_sql("c_custkey")} AS x, {lat_sql("c_custkey")} AS y FROM customer), s AS (SELECT 's:' || s_suppkey AS b, {lon_sql("s_suppkey")} AS u, {lat_sql("s_suppkey")} AS v FROM supplier),
p AS (SELECT id, b, {haversine_sql("x", "y", "u", "v")} AS d FROM c, s) SELECT c.id, count(b) AS n, arg_min(b, (d, b)) AS nearest FROM c LEFT JOIN (SELECT * FROM p WHERE d <= 50000.0) AS q USING (id) GROUP BY c.id""")
def events_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the events, named by text, within 50 km."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    found = spatial.related(c, s)
    return found.select("id", F.size("related").cast("bigint").alias("n"), F.get("related", 0)["b"].alias("nearest"))


@query(f"""WITH c AS (SELECT c_custkey AS id, c_nationkey AS aoi, {lon_sql("c_custkey")} AS x, {lat_sql("c_custkey")} AS y FROM customer), s AS (SELECT s_nationkey AS aoi, {lon_sql("s_suppkey")} AS u, {lat_sql("s_suppkey")} AS v FROM supplier WHERE s_nationkey % 5 > 0)
SELECT id, round(min({haversine_sql("x", "y", "u", "v")}), 3) AS water_m FROM c JOIN s USING (aoi) GROUP BY id""")
def water_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres to the nearest water of a change's own area; areas without any drop out."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("aoi_id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 5 > 0").select(F.col("s_nationkey").alias("aoi_id"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    return spatial.water_distance(c, s).select("id", F.round("water_m", 3).alias("water_m"))


@query("""WITH g AS (SELECT p_partkey AS id, 1 + p_partkey % 9 AS h, 1 + p_size % 5 AS w, 1 + p_partkey % 12 AS n FROM part) SELECT id, (n >= 4 AND greatest(h, w) >= 4 * least(h, w)) OR (n >= 6 AND greatest(h, w) >= 6 AND n / (h * w)::DOUBLE < 0.35) AS strip FROM g""")
def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), change.elongated(1 + k % 9, 1 + F.col("p_size") % 5, 1 + k % 12).alias("strip"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS type, count(*) AS n FROM events GROUP BY ALL""")
def days_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days by type: the projection of the stream, over a table."""
    days = streaming.daily_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"))
    return days.withColumn("day", F.col("day").cast("string"))


@query("""SELECT s_suppkey AS id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM (SELECT s_suppkey, 72.0::DOUBLE + (s_suppkey % 600) / 100.0::DOUBLE AS lon, 8.0::DOUBLE + (s_suppkey % 2500) / 100.0::DOUBLE AS lat FROM supplier)""")
def projected_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the UTM zone and back: within a hundredth of a metre."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), geo.lonlat_to_utm(72.0 + (k % 600) / 100.0, 8.0 + (k % 2500) / 100.0, 43).alias("u"))
    back = p.select("id", geo.utm_to_lonlat(F.col("u")["easting"], F.col("u")["northing"], 43).alias("b"))
    return back.select("id", F.round("b.lon", 7).alias("lon"), F.round("b.lat", 7).alias("lat"))


@query("""WITH m AS (SELECT p_partkey AS k, (p_partkey % 3)::VARCHAR AS aoi, strftime(DATE '2018-01-01' + (p_partkey * 37 % 2000)::INTEGER, '%Y-%m-%d') AS t0, strftime(DATE '2018-01-01' + (p_partkey * 91 % 2000)::INTEGER, '%Y-%m-%d') AS t1, p_size / 25.0 AS shift, 1 - p_size / 60.0 AS clear FROM part),
p AS (SELECT k, (CASE WHEN t0 >= t1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN shift > 1.0 THEN 1 ELSE 0 END + CASE WHEN clear < 0.5 THEN 1 ELSE 0 END) AS problems, abs(month(t0::DATE) - month(t1::DATE)) AS g, shift FROM m)
SELECT k AS id, problems, (least(g, 12 - g) > 1)::INT + (shift > 0.5)::INT AS warnings FROM p""")
def pairs_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that forbid comparing two scenes, and warnings that do not."""
    k = F.col("p_partkey")
    day = lambda n: F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (k * n % 2000).cast("int")), "yyyy-MM-dd")
    scene = lambda n, grid: F.struct((k % 3).cast("string").alias("aoi_id"), day(n).alias("acquired_at"), grid.alias("grid"))
    p = table(spark, sf_dir, "part").select(k.alias("id"), scene(37, F.lit("g")).alias("before"), scene(91, F.when(k % 4 == 0, "h").otherwise("g")).alias("after"), (F.col("p_size") / 25.0).alias("shift_px"), (1 - F.col("p_size") / 60.0).alias("joint_clear"))
    return imagery.admissible(p).select("id", F.size("problems").alias("problems"), F.size("warnings").alias("warnings"))


@query("""SELECT p_partkey AS id FROM part WHERE NOT (p_partkey % 4 = 0 AND p_size % 2 = 0)""")
def chips_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips that no cache holds for the same model."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), (F.col("p_size") % 2).cast("string")).alias("model_key"), F.lit("v1").alias("preprocess_version"))
    return imagery.uncached(p, p.where("id % 4 = 0").withColumn("model_key", F.lit("m0"))).select("id")


@query("""WITH v AS (SELECT c_custkey AS id, c_custkey % 7 > 0 AS okid, c_custkey % 5 > 0 AS okpos, c_custkey % 3 > 0 AS okt FROM customer) SELECT id, (NOT okid)::INT + (NOT okpos)::INT + (NOT okt)::INT AS problems FROM v""")
def vessel_reports_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports under the contract, with how many problems each has; sentinels for unknown are none."""
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 7 > 0, "123456789").otherwise("12").alias("identifier"), lon_of(k).alias("lon"), F.when(k % 5 > 0, lat_of(k)).otherwise(95.0).alias("lat"), F.when(k % 3 > 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00").alias("observed_at"), F.lit(360.0).alias("course_deg"), F.lit(102.3).alias("speed_kn"), F.lit(511.0).alias("heading_deg"))
    good, bad = feeds.vessel_reports(v)
    return good.select("id", F.lit(0).alias("problems")).union(bad.select("id", F.size("problems")))


@query("""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT * FROM x WHERE id % 20 = 0),
s AS (SELECT q.id AS query, x.id, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.e, x.e) DESC, x.id) AS r FROM q JOIN x ON q.id <> x.id) SELECT query, id, r::INTEGER AS rank FROM s WHERE r <= 5""")
def neighbours_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.nearest_rows(e, e.where("id % 20 = 0"), 5).select("query", "id", "rank")


@query("""SELECT d.doc_id::VARCHAR AS entry_id, p.problem FROM documents AS d, (VALUES ('unknown scene'), ('checksum differs')) AS p(problem)
WHERE (p.problem = 'unknown scene' AND d.doc_id % 10 = 0) OR (p.problem = 'checksum differs' AND d.doc_id % 10 > 0 AND d.doc_id % 7 = 0)""")
def manifests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose scene is unknown or whose checksum differs."""
    from orrery.operators import evaluation

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    entries = d.select(F.col("doc_id").cast("string").alias("entry_id"), F.col("doc_id").cast("string").alias("scene_id"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("h")).alias("sha256"), F.lit("test").alias("split"))
    scenes = d.where("doc_id % 10 > 0").select(F.col("doc_id").cast("string").alias("id"), F.col("h").alias("sha256"))
    return evaluation.manifest_problems(entries, scenes)


@query("""WITH l AS (SELECT o_orderkey AS site_id, o_orderstatus = 'F' AS changed, o_orderdate AS first, o_orderdate + INTERVAL 90 DAY AS last FROM orders), hit AS (SELECT DISTINCT o_orderkey AS site_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY)
SELECT site_id, CASE WHEN changed AND hit.site_id IS NOT NULL THEN 'tp' WHEN hit.site_id IS NOT NULL THEN 'fp' WHEN changed THEN 'fn' ELSE 'tn' END AS outcome FROM l LEFT JOIN hit USING (site_id)""")
def sites_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sites against candidates that share a tile and a time with them."""
    from orrery.operators import evaluation

    day = lambda c, n=0: F.date_format(F.date_add(F.to_date(c), n), "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders")
    labels = o.select(F.col("o_orderkey").alias("site_id"), (F.col("o_orderstatus") == "F").alias("changed"), F.array(F.col("o_orderkey").cast("string")).alias("tile_ids"), day("o_orderdate").alias("first"), day("o_orderdate", 30).alias("last"))
    found = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_orderkey").cast("string")).alias("tile_ids"), day("l_shipdate").alias("latest_before"), day("l_shipdate").alias("earliest_after"))
    return evaluation.site_outcomes(labels, found)
