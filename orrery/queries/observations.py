"""Searches, scoping, merges and timelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geo, text
from orrery.operators import merge, spatial, timeline
from orrery.queries.base import EVENTS_SQL, events, haversine_sql, iso, lat_of, lat_sql, lon_of, lon_sql, query, table

POINT, RADIUS, SINCE, UNTIL = (82.0, 21.0), 600_000.0, "2024-01-05T00:00:00Z", "2024-01-25T00:00:00Z"
WEST, SOUTH, EAST, NORTH = geo.circle_bbox(*POINT, RADIUS)
TRIANGLE = [(70.0, 10.0), (95.0, 12.0), (80.0, 33.0)]
#: Names of a gazetteer that may be broadcast.
BROADCAST_NAMES = 1_000_000
HOLE = [(80.0, 15.0), (84.0, 15.0), (84.0, 19.0), (80.0, 19.0)]


def ring(points: list[tuple[float, float]]):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


def crossings_sql(x: str, y: str, points: list[tuple[float, float]]) -> str:
    parts = []
    for (px, py), (qx, qy) in zip(points, points[1:] + points[:1], strict=True):
        if py != qy:
            parts.append(f"CASE WHEN ({py} > {y}) <> ({qy} > {y}) AND {x} < ({qx - px}::DOUBLE) * ({y} - {py}) / ({qy - py}::DOUBLE) + {px} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


@query(f"""WITH {EVENTS_SQL}, near AS (
  SELECT *, round({haversine_sql("lon", "lat", str(POINT[0]), str(POINT[1]))}, 1) AS distance_m FROM e
  WHERE type IN ('purchase', 'signup') AND start_time >= '{SINCE}' AND start_time < '{UNTIL}')
SELECT id, type, start_time, distance_m, 'within 600 km of the point' AS why FROM near WHERE distance_m <= {RADIUS}
ORDER BY distance_m, start_time DESC, id LIMIT 200""")
def events_near_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two types around a point in a window of time, nearest first, with the reason."""
    found = (
        events(spark, sf_dir)
        .where(F.col("type").isin("purchase", "signup") & timeline.within(F.col("start_time"), SINCE, UNTIL))
        .where(geo.in_bbox(F.col("lon"), F.col("lat"), WEST, SOUTH, EAST, NORTH))
        .withColumn("distance_m", F.round(geo.haversine(F.col("lon"), F.col("lat"), *POINT), 1))
        .where(F.col("distance_m") <= RADIUS)
    )
    return found.select("id", "type", "start_time", "distance_m", F.lit("within 600 km of the point").alias("why")).orderBy("distance_m", F.desc("start_time"), "id").limit(200)


@query(f"""WITH p AS (
  SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
SELECT kind, id, name, round({haversine_sql(lon_sql("id"), lat_sql("id"), "78.0", "20.0")}, 1) AS distance_m FROM p
WHERE {haversine_sql(lon_sql("id"), lat_sql("id"), "78.0", "20.0")} <= 300000.0 ORDER BY distance_m, name, kind LIMIT 200""")
def entities_in_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two kinds within a circle, by distance then name."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    placed = c.union(s).withColumns({"lon": lon_of(F.col("id")), "lat": lat_of(F.col("id"))})
    far = geo.haversine(F.col("lon"), F.col("lat"), 78.0, 20.0)
    found = placed.where(geo.in_bbox(F.col("lon"), F.col("lat"), *geo.circle_bbox(78.0, 20.0, 300_000.0)) & (far <= 300_000.0))
    return found.select("kind", "id", "name", F.round(far, 1).alias("distance_m")).orderBy("distance_m", "name", "kind").limit(200)


@query(f"""SELECT s_suppkey AS id, s_name AS name FROM (SELECT *, {lon_sql("s_suppkey")} AS x, {lat_sql("s_suppkey")} AS y FROM supplier)
WHERE {crossings_sql("x", "y", TRIANGLE)} % 2 = 1 AND {crossings_sql("x", "y", HOLE)} % 2 = 0""")
def entities_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities inside a polygon with a hole, by a cell join and ray casting."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    area = spark.range(1).select(F.lit("triangle").alias("area"), F.array(F.array(ring(TRIANGLE), ring(HOLE))).alias("polygons"))
    return spatial.inside_areas(s, area).select("id", "name")


@query(f"""WITH o AS (
  SELECT o_orderkey AS k, {lon_sql("o_orderkey")} AS x, CASE WHEN o_orderkey % 97 = 0 THEN 95.0 WHEN o_orderkey % 89 = 0 THEN NULL ELSE {lat_sql("o_orderkey")} END AS y FROM orders),
r AS (SELECT CASE WHEN y IS NULL THEN 'missing geometry' WHEN abs(y) > 90 THEN 'coordinate out of range' END AS reason, x, y FROM o),
d AS (SELECT CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN x BETWEEN 70 AND 90 AND y BETWEEN 10 AND 30 THEN 'inside' ELSE 'outside' END AS disposition, reason FROM r)
SELECT disposition, reason, count(*) AS n FROM d GROUP BY ALL""")
def scope_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation, geographic scope and counts by disposition and reason."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(lon_of(k).alias("lon"), F.when(k % 97 == 0, F.lit(95.0)).when(k % 89 == 0, F.lit(None).cast("double")).otherwise(lat_of(k)).alias("lat"))
    reason = F.coalesce(F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing geometry"), F.when((F.abs("lat") > 90) | (F.abs("lon") > 180), "coordinate out of range"))
    inside = geo.in_bbox(F.col("lon"), F.col("lat"), 70.0, 10.0, 90.0, 30.0)
    d = o.withColumn("reason", reason).withColumn("disposition", F.when(F.col("reason").isNotNull(), "invalid").when(inside, "inside").otherwise("outside"))
    return d.groupBy("disposition", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS_SQL}
SELECT greatest(substr(start_time, 1, 10), '2024-01-10') AS day, category, count(*) AS n FROM e
WHERE start_time >= '2024-01-10T00:00:00Z' AND start_time <= '2024-01-20T23:59:59Z' AND type IN ('view', 'purchase') GROUP BY ALL""")
def timeline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.density(events(spark, sf_dir), "2024-01-10T00:00:00Z", "2024-01-20T23:59:59Z", ["view", "purchase"])


@query(f"""WITH {EVENTS_SQL}
SELECT greatest(substr(start_time, 1, 10), '2024-01-10') AS day, count(*) AS n FROM e
WHERE start_time >= '2024-01-10T00:00:00Z' AND start_time <= '2024-01-20T23:59:59Z' AND (type IN ('click') OR lon IS NULL) GROUP BY ALL""")
def timeline_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.telemetry(events(spark, sf_dir), "2024-01-10T00:00:00Z", "2024-01-20T23:59:59Z", ["click"])


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT substr(start_time, 1, 10)::DATE AS day, count(*) AS n FROM e WHERE start_time >= '2024-01-02' AND start_time < '2024-01-30' GROUP BY ALL),
spine AS (SELECT unnest(generate_series(DATE '2024-01-02', DATE '2024-01-29', INTERVAL 1 DAY))::DATE AS d),
b AS (SELECT d, date_diff('day', DATE '2024-01-02', d) // 4 AS bin FROM spine)
SELECT bin::INTEGER AS bin, min(b.d)::VARCHAR AS first_day, coalesce(sum(n), 0)::BIGINT AS n FROM b LEFT JOIN d ON d.day = b.d GROUP BY bin""")
def timeline_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days summed into at most eight bins of equal length."""
    days = events(spark, sf_dir).where(timeline.within(F.col("start_time"), "2024-01-02", "2024-01-30")).groupBy(F.substring("start_time", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.binned(days, "2024-01-02", "2024-01-29", 8)


@query(f"""WITH {EVENTS_SQL}
SELECT id, type, start_time, false AS scheduled FROM e WHERE type = 'purchase' AND start_time >= '2024-01-18T00:00:00Z' AND start_time <= '2024-01-20T00:00:00Z' AND lon IS NOT NULL
UNION ALL SELECT id, type, start_time, true FROM e WHERE type = 'signup' AND start_time > '2024-01-20T00:00:00Z' AND start_time <= '2024-01-22T00:00:00Z'""")
def upcoming_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past events of one type and scheduled ones of another, marked."""
    e, now = events(spark, sf_dir), "2024-01-20T00:00:00Z"
    past = e.where((F.col("type") == "purchase") & timeline.overlaps(F.col("start_time"), F.col("end_time"), "2024-01-18T00:00:00Z", now) & F.col("lon").isNotNull())
    soon = timeline.upcoming(e, now, "2024-01-22T00:00:00Z", ["signup"])
    return past.withColumn("scheduled", F.lit(False)).unionByName(soon.withColumn("scheduled", F.lit(True))).select("id", "type", "start_time", "scheduled")


@query(f"WITH {EVENTS_SQL} SELECT id, type, coalesce(CAST(attributes ->> '$.k' AS DOUBLE), 0.0) AS magnitude FROM e WHERE coalesce(CAST(attributes ->> '$.k' AS DOUBLE), 0.0) >= 90.0")
def json_attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold on a number inside JSON; an absent number counts as 0."""
    m = F.coalesce(F.get_json_object("attributes", "$.k").try_cast("double"), F.lit(0.0))
    return events(spark, sf_dir).withColumn("magnitude", m).where("magnitude >= 90.0").select("id", "type", "magnitude")


@query("""WITH o AS (SELECT event_id AS id, 'first' AS source_id, value, 1 AS created_at FROM events WHERE event_id % 3 <> 0),
n AS (SELECT event_id AS id, 'second' AS source_id, value * 2 AS value, 2 AS created_at FROM events WHERE event_id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.id IS NOT NULL THEN n.value ELSE o.value END AS value,
coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n ON o.id = n.id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key; source and creation stay."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.lit("first").alias("source_id"), "value", F.lit(1).alias("created_at"))
    new = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit("second").alias("source_id"), (F.col("value") * 2).alias("value"), F.lit(2).alias("created_at"))
    return merge.upserted(old, new)


@query("""SELECT o_orderkey AS id, o_orderpriority AS source_id, o_totalprice AS price FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, o_orderpriority, 0.0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0""")
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source's rows exchanged, the others untouched."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_id"), F.col("o_totalprice").alias("price"))
    return merge.replaced_source(o, o.where("source_id = '1-URGENT' and id % 2 = 0").withColumn("price", F.lit(0.0)), "1-URGENT")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def new_key_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(f"""WITH c AS (SELECT c_custkey AS a, {lon_sql("c_custkey")} AS x, {lat_sql("c_custkey")} AS y FROM customer), s AS (SELECT s_suppkey AS b, {lon_sql("s_suppkey")} AS u, {lat_sql("s_suppkey")} AS v FROM supplier),
p AS (SELECT a, b, {haversine_sql("x", "y", "u", "v")} AS d FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM p WHERE d <= 100000.0)
SELECT a, b, round(d, 3) AS distance_m, rank::INTEGER AS rank FROM r WHERE rank <= 15""")
def proximity_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, the 15 nearest suppliers within 100 km, through a cell join."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    return spatial.nearest_k(spatial.proximity(c, s, 100_000.0), 15).withColumn("distance_m", F.round("distance_m", 3))


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS kind, {lon_sql("s_suppkey")} AS x, {lat_sql("s_suppkey")} AS y FROM supplier),
p AS (SELECT a.k AS a, b.k AS b, a.kind, {haversine_sql("a.x", "a.y", "b.x", "b.y")} AS d FROM s a JOIN s b ON a.kind = b.kind AND a.k <> b.k)
SELECT a, b, kind, round(d, 3) AS distance_m, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) WHERE r <= 5""")
def nearest_same_type_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kind"), lon_of(F.col("s_suppkey")).alias("lon"), lat_of(F.col("s_suppkey")).alias("lat"))
    return spatial.nearest_of_kind(s, "s_suppkey", "kind", 5).withColumn("distance_m", F.round("distance_m", 3))


SITES = [("north", 77.0, 28.0), ("east", 88.0, 22.5), ("south", 77.5, 12.5), ("west", 72.5, 19.0)]


@query(f"""WITH c AS (SELECT c_custkey AS id, {lon_sql("c_custkey")} AS x, {lat_sql("c_custkey")} AS y FROM customer), s(site, u, v) AS (VALUES {", ".join(f"('{n}', {x}, {y})" for n, x, y in SITES)}),
p AS (SELECT id, site, {haversine_sql("x", "y", "u::DOUBLE", "v::DOUBLE")} AS d FROM c, s)
SELECT id, site, round(d, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, site) AS r FROM p) WHERE r = 1""")
def nearest_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"))
    return spatial.nearest_site(c, SITES).withColumn("distance_m", F.round("distance_m", 3))


VOCABULARY = [("idiot|moron|clown", "insult"), ("[ \\n]licensed?[ \\n]", "licence"), ("[ \\n]the [^.]*[ \\n]and ", "english"), ("[ \\n](der|und) ", "german"), ("[ \\n]que ", "romance")]


@query(f"""SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(lower(text), '{p}', 's') THEN '{v}'" for p, v in VOCABULARY)} END AS term FROM documents""")
def vocab_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of an ordered vocabulary that a text matches."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_match(F.lower("text"), VOCABULARY).alias("term"))


@query("""WITH k AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_retailprice AS weight FROM part)
SELECT id, key, CASE WHEN key = 'red' THEN 0 WHEN starts_with(key, 'red') THEN 1 ELSE 2 END AS fit FROM k WHERE contains(key, 'red') OR contains(key, 'ed') ORDER BY fit, weight DESC, key, id LIMIT 50""")
def normalise_key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by folded key: exact, then beginning with, then containing; the weightier first."""
    key = text.fold_ascii(F.col("p_name"))
    fit = F.when(F.col("key") == "red", 0).when(F.col("key").startswith("red"), 1).otherwise(2)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), F.col("p_retailprice").alias("weight"))
    return p.where(F.col("key").contains("red") | F.col("key").contains("ed")).withColumn("fit", fit).orderBy("fit", F.desc("weight"), "key", "id").limit(50).select("id", "key", "fit")


@query("""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
r AS (SELECT trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM region),
n AS (SELECT n AS key FROM r UNION SELECT 'the ' || n FROM r UNION SELECT unnest(['and the', 'of the', 'die der']) UNION SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) FROM nation)
SELECT doc_id, max(struct_pack(l := length(key), k := key)).k AS place FROM d JOIN n ON contains(t, ' ' || key || ' ') GROUP BY doc_id""")
def place_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of a gazetteer that stands in a text as whole words: regions, nations and three phrases.

    The runs of a text's words, up to the longest name's, meet the names in an equi-join.
    """
    region = table(spark, sf_dir, "region").select(text.fold_ascii(F.col("r_name")).alias("n"))
    nation = table(spark, sf_dir, "nation").select(text.fold_ascii(F.col("n_name")).alias("n"))
    named = region.select(F.explode(F.array(F.col("n"), F.concat(F.lit("the "), F.col("n")), F.lit("and the"), F.lit("of the"), F.lit("die der"))).alias("key"))
    keys = named.union(nation.select(F.col("n").alias("key"))).where("key <> ''").distinct()
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("key", " "))).alias("words")).first()
    w = table(spark, sf_dir, "documents").select("doc_id", F.split(text.fold_ascii(F.col("text")), " ").alias("w"))
    runs = [F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(size["words"] or 1)]
    words = w.select("doc_id", F.inline(F.arrays_zip(*runs)))
    grams = words.select("doc_id", F.explode(F.array(*[F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)]) for k in range(len(runs))])).alias("key"))
    hits = grams.join(F.broadcast(keys) if size["n"] <= BROADCAST_NAMES else keys, "key")
    return hits.groupBy("doc_id").agg(F.max(F.struct(F.length("key").alias("l"), F.col("key").alias("k")))["k"].alias("place"))


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT user_id AS source, max(start_time) AS last FROM e GROUP BY user_id),
a AS (SELECT *, CASE WHEN source % 7 <> 3 THEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last::TIMESTAMP)) / 3600.0 END AS age_h, source % 11 <> 0 AS adapter, source % 13 <> 0 AS key_present,
  CASE source % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'rate-limited' ELSE 'ok' END AS health, CASE WHEN source % 3 > 0 THEN 48 END AS stale, CASE WHEN source % 2 = 0 THEN 12 END AS late FROM u),
s AS (SELECT *, CASE WHEN NOT adapter THEN 'NOT IMPLEMENTED' WHEN NOT key_present THEN 'KEY REQUIRED' WHEN age_h IS NULL AND health IN ('failed', 'rate-limited') THEN 'UNAVAILABLE' WHEN age_h IS NULL THEN 'NOT STAGED'
  WHEN age_h > stale THEN 'STALE' WHEN health = 'ok' AND age_h > late THEN 'DELAYED' WHEN health = 'ok' THEN 'LIVE' ELSE 'SNAPSHOT' END AS state FROM a)
SELECT source, round(age_h::DOUBLE, 6) AS age_h, state, CASE WHEN state NOT IN ('SNAPSHOT', 'STALE') THEN '' WHEN health = 'failed' THEN 'LAST REFRESH FAILED' WHEN health = 'rate-limited' THEN 'RATE LIMITED' ELSE '' END AS warning FROM s""")
def freshness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each source, here a user, from its setting, the health of its last run and the age of its newest record."""
    from orrery.operators.governance import freshness

    k = F.col("source")
    newest = events(spark, sf_dir).groupBy(F.col("user_id").alias("source")).agg(F.max("start_time").alias("last"))
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.to_timestamp("last"))) / 3600.0
    sources = newest.select(
        k,
        F.when(k % 7 != 3, age).alias("age_h"),
        (k % 11 != 0).alias("adapter"),
        (k % 13 != 0).alias("key_present"),
        F.when(k % 5 == 0, "failed").when(k % 5 == 1, "rate-limited").otherwise("ok").alias("health"),
        F.when(k % 3 > 0, 48.0).alias("stale_after_hours"),
        F.when(k % 2 == 0, 12.0).alias("delayed_after_hours"),
    )
    return freshness(sources).select("source", F.round("age_h", 6).alias("age_h"), "state", F.regexp_extract("label", "(LAST REFRESH FAILED|RATE LIMITED)", 1).alias("warning"))


@query("""SELECT 'events' AS name, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing FROM events
UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders
UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE text IS NULL) FROM documents""")
def system_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of several tables, one pass each."""
    parts = [("events", F.col("value").isNull()), ("orders", F.col("o_orderstatus") == "F"), ("documents", F.col("text").isNull())]
    out = None
    for name, p in parts:
        one = table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(p).alias("missing"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT event_type AS layer, count(*) AS n, string_agg(DISTINCT (user_id % 5)::VARCHAR, ',' ORDER BY (user_id % 5)::VARCHAR) AS sources, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS updated FROM events GROUP BY event_type""")
def layer_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sources and latest time of each layer."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("layer")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string"))), ",").alias("sources"), F.max(iso(F.col("ts"))).alias("updated")
    )


@query("""SELECT o_orderkey AS id, o_orderstatus AS review_state, o_totalprice AS score, c_nationkey AS aoi, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY (o_orderstatus = 'O') DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders LEFT JOIN customer ON o_custkey = c_custkey) WHERE rank <= 200""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cases first, then by score: the limit comes before the numbering, so ranks need no global sort."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    order = [F.desc(F.col("o_orderstatus") == "O"), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = o.orderBy(*order).limit(200).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("review_state"), F.col("o_totalprice").alias("score"), F.col("c_nationkey").alias("aoi"), "rank"
    )


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def left_join_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows, with what they are about where it is known; the limit comes first."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    c = table(spark, sf_dir, "customer")
    return newest.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("c_name").alias("name"))


@query("""SELECT month, id, rank::INTEGER AS rank FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS id,
  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def month_best3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each month."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    order = Window.partitionBy("month").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("month", F.col("o_orderkey").alias("id"), "rank")
