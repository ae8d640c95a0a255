"""Queries of feeds: tables written as a feed's documents and read by its adapter; the SQL states what a record is."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.queries.base import EVENTS_SQL, events, lat_of, lon_of, lon_sql, query, table
from orrery.sources import feeds
from orrery.staging import shared_dir


def _through_feed(rows: DataFrame, feed: str, document: Column) -> DataFrame:
    """rows written as documents of a feed, each an aggregate of some thousand rows, and read by its adapter.

    One document a file: some feeds are read as whole files. Tasks write the documents that they have put together:
    ordering or dealing them out again by their texts would send samples of whole documents to the driver.
    """
    path = f"{shared_dir(rows.sparkSession)}/feed-{feed}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("doc__", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, rows.count() // 1000)))).repartition("doc__")
    dealt.groupBy("doc__").agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return feeds.read(rows.sparkSession, feed, path)


def _listed(one: Column, name: str) -> Column:
    return F.to_json(F.struct(F.collect_list(one).alias(name)))


def _through_csv(rows: DataFrame, feed: str) -> DataFrame:
    path = f"{shared_dir(rows.sparkSession)}/feed-{feed}-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True)
    return feeds.read(rows.sparkSession, feed, path)


def _fact(name: str) -> Column:
    return F.get_json_object("attributes", f"$.{name}").alias(name)


def _seconds() -> Column:
    return F.unix_timestamp(F.to_timestamp("start_time"))


def _rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT *, CASE WHEN id % 11 > 0 THEN (id % 90)::DOUBLE / 10 END AS mag, CASE WHEN id % 7 > 0 THEN type END AS place FROM e)
SELECT id::VARCHAR AS record_id, 'DISASTERS' AS category, 'M' || coalesce(mag::VARCHAR, 'None') || ' earthquake - ' || coalesce(place, 'location text not given') AS title, start_time,
  CASE WHEN id % 2 = 0 THEN 'reviewed' ELSE 'automatic' END AS status, CASE WHEN id % 2 = 0 THEN 'VERIFIED RECORD' ELSE 'OBSERVED' END AS evidence_type, round(lon, 6) AS lon, round(lat, 6) AS lat, mag AS magnitude, (id % 300)::DOUBLE AS depth_km FROM q""")
def feed_of_earthquakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoJSON feed."""
    k = F.col("id")
    properties = F.struct(F.when(k % 11 > 0, (k % 90) / 10.0).alias("mag"), F.when(k % 7 > 0, F.col("type")).alias("place"), (_seconds() * 1000).alias("time"), F.when(k % 2 == 0, "reviewed").otherwise("automatic").alias("status"))
    one = F.struct(k.cast("string").alias("id"), F.struct(F.array("lon", "lat", (k % 300).cast("double")).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    read = _through_feed(events(spark, sf_dir), "earthquakes", _listed(one, "features"))
    return read.select("record_id", "category", "title", "start_time", "status", "evidence_type", *_rounded("lon", "lat"), _fact("magnitude").cast("double").alias("magnitude"), _fact("depth_km").cast("double").alias("depth_km"))


@query(f"""WITH {EVENTS_SQL} SELECT id::VARCHAR AS record_id, CASE type WHEN 'view' THEN 'wildfire' WHEN 'click' THEN 'severe-storm' WHEN 'purchase' THEN 'sea-lake-ice' WHEN 'signup' THEN 'manmade' ELSE 'natural-event' END AS type,
  CASE type WHEN 'view' THEN 'ENVIRONMENT' WHEN 'click' THEN 'WEATHER' WHEN 'purchase' THEN 'ENVIRONMENT' WHEN 'signup' THEN 'PUBLIC EVENTS' ELSE 'DISASTERS' END AS category,
  start_time, CASE WHEN id % 3 = 0 THEN '2024-02-01T00:00:00Z' END AS end_time, CASE WHEN id % 3 = 0 THEN 'closed' ELSE 'open' END AS status, 'OBSERVED' AS evidence_type, round(lon + 1, 6) AS lon, round(lat, 6) AS lat, '2' AS geometry_count, (id % 10)::DOUBLE AS magnitude FROM e""")
def feed_of_natural_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested arrays: the first date, the last place, and a category's name and group."""
    k = F.col("id")
    kind = F.when(F.col("type") == "view", "wildfires").when(F.col("type") == "click", "severeStorms").when(F.col("type") == "purchase", "seaLakeIce").when(F.col("type") == "signup", "manmade").otherwise("other")
    at = lambda t, dx: F.struct(t.alias("date"), F.lit("Point").alias("type"), F.array(F.col("lon") + dx, F.col("lat")).alias("coordinates"), (k % 10).cast("double").alias("magnitudeValue"))
    one = F.struct(k.cast("string").alias("id"), F.col("type").alias("title"), F.when(k % 3 == 0, "2024-02-01T00:00:00Z").alias("closed"), F.array(F.struct(kind.alias("id"))).alias("categories"), F.array(at(F.col("start_time"), 0.0), at(F.lit("2024-02-01T00:00:00Z"), 1.0)).alias("geometry"))
    read = _through_feed(events(spark, sf_dir), "natural-events", _listed(one, "events"))
    return read.select("record_id", "type", "category", "start_time", "end_time", "status", "evidence_type", *_rounded("lon", "lat"), _fact("geometry_count"), _fact("magnitude").cast("double").alias("magnitude"))


@query(f"""WITH {EVENTS_SQL}, a(k, code, type, category) AS (VALUES (0, 'EQ', 'earthquake', 'DISASTERS'), (1, 'TC', 'cyclone', 'WEATHER'), (2, 'FL', 'flood', 'DISASTERS'), (3, 'DR', 'drought', 'ENVIRONMENT'), (4, 'WF', 'wildfire', 'ENVIRONMENT'), (5, 'VO', 'volcano', 'DISASTERS'), (6, 'XX', 'disaster-alert', 'DISASTERS'))
SELECT code || '-' || id || '-' || CASE WHEN id % 4 = 0 THEN 'None' ELSE '1' END AS record_id, a.type, a.category, CASE WHEN id % 3 = 0 THEN 'Name' WHEN id % 3 = 1 THEN 'Described' ELSE 'GDACS alert' END AS title,
  start_time, CASE WHEN id % 2 = 0 THEN 'current' ELSE 'past' END AS status, 'INFERRED' AS evidence_type, round(lat, 6) AS lat, 'Green' AS alert_level FROM e JOIN a ON a.k = id % 7""")
def feed_of_disaster_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and groups by code; times without a zone are in UTC."""
    k = F.col("id")
    code = F.element_at(F.array(*map(F.lit, ["EQ", "TC", "FL", "DR", "WF", "VO", "XX"])), (k % 7 + 1).cast("int"))
    properties = F.struct(
        code.alias("eventtype"), k.cast("string").alias("eventid"), F.when(k % 4 > 0, "1").alias("episodeid"), F.when(k % 3 == 0, "Name").when(k % 3 == 1, "").alias("name"), F.when(k % 3 < 2, "Described").alias("description"),
        F.lit("Green").alias("alertlevel"), F.expr("rtrim('Z', start_time)").alias("fromdate"), F.when(k % 2 == 0, "true").otherwise("false").alias("iscurrent"),
    )
    one = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    read = _through_feed(events(spark, sf_dir), "disaster-alerts", _listed(one, "features"))
    return read.select("record_id", "type", "category", "title", "start_time", "status", "evidence_type", *_rounded("lat"), _fact("alert_level"))


@query(f"""WITH {EVENTS_SQL} SELECT 'x' || id AS record_id, 'Aircraft ' || CASE WHEN id % 4 = 0 THEN 'x' || id ELSE 'F' || id END AS title, 'AVIATION' AS category, start_time, CASE WHEN id % 5 = 0 THEN 'on-ground' ELSE 'airborne' END AS status, 'OBSERVED' AS evidence_type,
  round(lon, 6) AS lon, CASE WHEN id % 4 > 0 THEN 'F' || id END AS callsign FROM e WHERE lon IS NOT NULL""")
def feed_of_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional arrays; a blank call sign gives way to the id, a position time of 0 to the last contact; without a position there is no record."""
    k = F.col("id")
    t, s = _seconds().cast("string"), lambda c: c.cast("string")
    one = F.array(F.concat(F.lit("x"), s(k)), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("F"), s(k), F.lit(" "))), F.lit("IN"), F.when(k % 3 == 0, "0").otherwise(t), t, s(F.col("lon")), s(F.col("lat")), F.lit("1000"), s(k % 5 == 0), F.lit("200"), F.lit("90"), F.lit("0"))
    read = _through_feed(events(spark, sf_dir), "aircraft", _listed(one, "states"))
    return read.select("record_id", "title", "category", "start_time", "status", "evidence_type", *_rounded("lon"), _fact("callsign"))


@query(f"""WITH {EVENTS_SQL}, s(k, code, name) AS (VALUES (0, 'bgp', 'BGP routing visibility'), (1, 'ping-slash24', 'Active probing'), (2, 'merit-nt', 'Network telescope'), (3, 'other', 'other')),
o AS (SELECT *, CASE WHEN id % 50 = 0 THEN 0 ELSE epoch(start_time::TIMESTAMP)::BIGINT END AS began, CASE WHEN id % 6 = 0 THEN 0 ELSE 3600 END AS lasting FROM e)
SELECT code || '-' || began AS record_id, 'Internet outage signal in India (' || name || ')' AS title, 'CONNECTIVITY' AS category, strftime(to_timestamp(began), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
  CASE WHEN began <> 0 THEN strftime(to_timestamp(began + lasting), '%Y-%m-%dT%H:%M:%SZ') END AS end_time, 'detected' AS status, 'INFERRED' AS evidence_type, 'national' AS scope, id::VARCHAR AS method FROM o JOIN s ON s.k = id % 4""")
def feed_of_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start and a duration become an interval; a start of 0 has no end."""
    k = F.col("id")
    code = F.element_at(F.array(*map(F.lit, ["bgp", "ping-slash24", "merit-nt", "other"])), (k % 4 + 1).cast("int"))
    one = F.struct(code.alias("datasource"), F.when(k % 50 == 0, F.lit(0).cast("bigint")).otherwise(_seconds()).alias("start"), F.when(k % 6 > 0, 3600).alias("duration"), k.cast("string").alias("method"), F.lit(1.5).alias("score"))
    read = _through_feed(events(spark, sf_dir), "outages", _listed(one, "data"))
    return read.select("record_id", "title", "category", "start_time", "end_time", "status", "evidence_type", "scope", _fact("method"))


@query(f"""WITH {EVENTS_SQL} SELECT replace(rtrim(start_time, 'Z'), 'T', CASE WHEN id % 2 = 0 THEN 'T' ELSE ' ' END) AS record_id, 'Planetary Kp ' || (id % 10) || '.25' || CASE WHEN id % 10 >= 5 THEN ' (storm level)' ELSE '' END AS title, 'SPACE' AS category, start_time,
  'observed' AS status, 'OBSERVED' AS evidence_type, 'global' AS scope, id::VARCHAR AS station_count FROM e""")
def feed_of_kp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of the feed: objects, and a table whose first row names its columns in any order."""
    k = F.col("id")
    e = events(spark, sf_dir).select("id", "start_time")
    tag, kp = F.expr("rtrim('Z', start_time)"), (k % 10).cast("double") + 0.25
    objects = F.to_json(F.collect_list(F.struct(tag.alias("time_tag"), kp.alias("Kp"), k.alias("station_count"))))
    rows = F.array(k.cast("string"), F.replace(tag, F.lit("T"), F.lit(" ")), kp.cast("string"))
    shaped = F.to_json(F.concat(F.array(F.array(*map(F.lit, ["station_count", "time_tag", "Kp"]))), F.collect_list(rows)))
    read = _through_feed(e.where("id % 2 = 0"), "kp-index", objects).union(_through_feed(e.where("id % 2 = 1"), "kp-index", shaped))
    return read.select("record_id", "title", "category", "start_time", "status", "evidence_type", "scope", _fact("station_count"))


@query(f"""WITH {EVENTS_SQL} SELECT id::VARCHAR AS record_id, 'Launch ' || id AS title, 'SPACE' AS category, CASE WHEN id % 3 = 0 THEN 'OK' WHEN id % 2 = 0 THEN 'Success' ELSE 'Go' END AS status, 'VERIFIED RECORD' AS evidence_type, start_time, round(lon, 6) AS lon,
  (id % 2 = 1)::VARCHAR AS upcoming, CASE WHEN id % 5 = 0 THEN 'Month' END AS time_precision FROM e WHERE lon IS NOT NULL""")
def feed_of_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents in one, launches to come and launches past; one without a pad's place is no record."""
    k = F.col("id")
    pad = F.struct(F.lit("pad").alias("name"), F.col("lon").cast("string").alias("longitude"), F.col("lat").cast("string").alias("latitude"))
    one = lambda said: F.struct(k.cast("string").alias("id"), F.concat(F.lit("Launch "), k.cast("string")).alias("name"), F.col("start_time").alias("net"), F.struct(F.lit(said).alias("name"), F.when(k % 3 == 0, "OK").alias("abbrev")).alias("status"), F.struct(F.when(k % 5 == 0, "Month").alias("name")).alias("net_precision"), pad.alias("pad"))
    listed = lambda c, name: F.struct(F.collect_list(c).alias("results")).alias(name)
    document = F.to_json(F.struct(listed(F.when(k % 2 == 1, one("Go")), "upcoming"), listed(F.when(k % 2 == 0, one("Success")), "previous")))
    read = _through_feed(events(spark, sf_dir), "launches", document)
    return read.select("record_id", "title", "category", "status", "evidence_type", "start_time", *_rounded("lon"), _fact("upcoming"), _fact("time_precision"))


@query(f"""WITH {EVENTS_SQL} SELECT 'City' || id || '-' || rtrim(start_time, 'Z') AS record_id, 'City' || id || ': ' || (10.5 + id % 20)::DOUBLE || '°C, wind ' || CASE WHEN id % 8 = 0 THEN 'None' ELSE (id % 9)::VARCHAR END || ' km/h' AS title, 'WEATHER' AS category, start_time,
  'model-analysis' AS status, 'INFERRED' AS evidence_type, round(lat, 6) AS lat, 'State' || id % 3 AS state FROM e""")
def feed_of_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of cities and answers."""
    k = F.col("id")
    s = k.cast("string")
    city = F.struct(F.concat(F.lit("City"), s).alias("name"), F.concat(F.lit("State"), (k % 3).cast("string")).alias("state"), F.array("lon", "lat").alias("coordinates"))
    now = F.struct(F.expr("rtrim('Z', start_time)").alias("time"), (10.5 + k % 20).alias("temperature_2m"), F.when(k % 8 > 0, k % 9).alias("wind_speed_10m"))
    answer = F.struct(now.alias("current"), F.struct(F.lit("°C").alias("temperature_2m"), F.lit("km/h").alias("wind_speed_10m")).alias("current_units"))
    both = F.array_sort(F.collect_list(F.struct(k.alias("k"), city.alias("c"), answer.alias("a"))))
    read = _through_feed(events(spark, sf_dir), "weather", F.to_json(F.struct(F.transform(both, lambda x: x["c"]).alias("cities"), F.transform(both, lambda x: x["a"]).alias("response"))))
    return read.select("record_id", "title", "category", "start_time", "status", "evidence_type", *_rounded("lat"), _fact("state"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT *, substr(start_time, 1, 10) AS day, lpad((id % 24 * 100 + id % 60)::VARCHAR, 4, '0') AS clock FROM e)
SELECT (id % 90) || '-' || id || '-' || day || '-' || clock || '-N' AS record_id, 'Thermal anomaly (VIIRS, ' || CASE WHEN id % 2 = 0 THEN 'day' ELSE 'night' END || ')' AS title, 'ENVIRONMENT' AS category, day || 'T' || left(clock, 2) || ':' || right(clock, 2) || ':00Z' AS start_time,
  'detected' AS status, 'OBSERVED' AS evidence_type, (id % 90)::DOUBLE AS lat, CASE id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'nominal' WHEN 2 THEN 'high' ELSE '77' END AS source_confidence FROM f""")
def feed_of_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a clock without zeros in front."""
    k = F.col("id")
    rows = events(spark, sf_dir).select(
        (k % 90).alias("latitude"), k.alias("longitude"), F.substring("start_time", 1, 10).alias("acq_date"), (k % 24 * 100 + k % 60).alias("acq_time"), F.lit("N").alias("satellite"), F.lit("VIIRS").alias("instrument"),
        F.when(k % 2 == 0, "D").otherwise("N").alias("daynight"), F.element_at(F.array(*map(F.lit, ["l", "n", "h", "77"])), (k % 4 + 1).cast("int")).alias("confidence"), F.lit(1.5).alias("frp"),
    )
    return _through_csv(rows, "fires").select("record_id", "title", "category", "start_time", "status", "evidence_type", "lat", _fact("source_confidence"))


@query(f"""SELECT 'A' || s_suppkey AS record_id, s_name AS name, 'AVIATION' AS category, round({lon_sql("s_suppkey")}, 6) AS lon, CASE WHEN s_suppkey % 2 = 0 THEN 'large airport' ELSE 'small airport' END AS airport_type, (s_suppkey % 4 = 0)::VARCHAR AS scheduled_service, CASE WHEN s_suppkey % 7 > 0 THEN 'I' || s_suppkey END AS iata
FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 > 0""")
def feed_of_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a world's table, one country's airports; heliports and closed ones stay out."""
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "heliport").when(k % 2 == 0, "large_airport").otherwise("small_airport")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("A"), k.cast("string")).alias("ident"), kind.alias("type"), F.col("s_name").alias("name"), lat_of(k).alias("latitude_deg"), lon_of(k).alias("longitude_deg"), F.lit("10").alias("elevation_ft"),
        F.when(k % 3 > 0, "IN").otherwise("US").alias("iso_country"), F.when(k % 7 > 0, F.concat(F.lit("I"), k.cast("string"))).otherwise("").alias("iata_code"), F.when(k % 4 == 0, "yes").otherwise("no").alias("scheduled_service"),
    )
    return _through_csv(rows, "airports").select("record_id", "name", "category", *_rounded("lon"), _fact("airport_type"), _fact("scheduled_service"), _fact("iata"))
