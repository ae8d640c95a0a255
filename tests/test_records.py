import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.operators import change, evaluation, governance, ingest, merge, timeline
from orrery.sources import feeds, shapefile
from orrery.streaming import observations as streaming


def write(tmp_path, name, value):
    p = tmp_path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def facts(row):
    return json.loads(row.attributes)


def test_feed_of_earthquakes(spark, tmp_path):
    one = lambda i, status, **p: {"id": i, "geometry": {"coordinates": [77.0, 28.0, 10.0]}, "properties": {"mag": 5.0, "time": 1767225600000, "status": status, "magType": "mb", "tsunami": 0, "url": "u", **p}}
    quakes = {"features": [one("q1", "reviewed", place="here"), one("q2", "automatic", mag=4, place=None)]}
    a, b = feeds.read(spark, "earthquakes", write(tmp_path, "q.json", quakes)).orderBy("record_id").collect()
    assert (a.title, a.start_time, a.evidence_type, a.category, a.lon) == ("M5.0 earthquake - here", "2026-01-01T00:00:00Z", "VERIFIED RECORD", "DISASTERS", 77.0)
    assert facts(a) == {"magnitude": 5.0, "magnitude_type": "mb", "depth_km": 10.0, "tsunami_flag": 0, "alert": None, "source_url": "u"}
    assert (b.title, b.evidence_type, b.status) == ("M4 earthquake - location text not given", "OBSERVED", "automatic")


def test_feed_of_natural_events(spark, tmp_path):
    fire = [{"date": "2026-01-01T00:00:00Z", "type": "Point", "coordinates": [1.0, 2.0]}, {"date": "2026-01-02T00:00:00Z", "type": "Point", "coordinates": [3, 4.5], "magnitudeValue": 9.5, "magnitudeUnit": "acres"}]
    area = [{"date": "2026-01-03", "type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 0]]]}]
    natural = {"events": [
        {"id": "n", "title": "Fire", "closed": None, "categories": [{"id": "wildfires"}], "sources": [{"id": "S", "url": ""}], "geometry": fire, "link": "l"},
        {"id": "p", "title": "Ice", "closed": "2026-02-01T00:00:00Z", "categories": [{"id": "unheard"}], "geometry": area}, {"id": "e", "title": "x", "geometry": []},
    ]}
    a, b = feeds.read(spark, "natural-events", write(tmp_path, "n.json", natural)).orderBy("record_id").collect()
    assert (a.type, a.category, a.lon, a.lat, a.start_time, a.status, a.end_time) == ("wildfire", "ENVIRONMENT", 3.0, 4.5, "2026-01-01T00:00:00Z", "open", None)
    assert facts(a) == {"eonet_category": "wildfires", "magnitude": 9.5, "magnitude_unit": "acres", "geometry_count": 2, "upstream_sources": ["S"], "source_url": "l"}
    assert (b.type, b.category, b.lon, b.lat, b.start_time, b.status, b.end_time) == ("natural-event", "DISASTERS", 2.0, 1.0, "2026-01-03T00:00:00Z", "closed", "2026-02-01T00:00:00Z")
    assert facts(b)["upstream_sources"] == []


def test_feed_of_disaster_alerts(spark, tmp_path):
    properties = {"eventtype": "TC", "eventid": 7, "name": "", "description": "Storm", "alertlevel": "Red", "alertscore": 2.5, "fromdate": "2026-01-01T01:00:00", "todate": "2026-01-02T01:00:00", "iscurrent": "true", "url": {"report": "r"}}
    r = feeds.read(spark, "disaster-alerts", write(tmp_path, "d.json", {"features": [{"geometry": {"type": "Point", "coordinates": [80, 20]}, "properties": properties}]})).first()
    assert (r.record_id, r.type, r.category, r.title, r.start_time, r.end_time, r.status, r.evidence_type, r.lon) == ("TC-7-None", "cyclone", "WEATHER", "Storm", "2026-01-01T01:00:00Z", "2026-01-02T01:00:00Z", "current", "INFERRED", 80.0)
    assert facts(r) == {"alert_level": "Red", "alert_score": 2.5, "country": None, "upstream_source": None, "source_url": "r"}


def test_feed_of_aircraft(spark, tmp_path):
    rest = [None] * 5
    planes = {"time": 5, "states": [["a1", " X ", "IN", 0, 100, 77.0, 28.0, 1.0, False, 2.0, 90.0, 0.5, *rest], ["a2", "  ", "IN", 50, 100, 77.0, 28.0, None, True, 2.0, 90.0, None, *rest], ["b", "Y", "IN", 5, 100, None, None, None, None, None, None, None, *rest]]}
    a, b = feeds.read(spark, "aircraft", write(tmp_path, "p.json", planes)).orderBy("record_id").collect()
    assert (a.title, a.start_time, a.status, a.category, a.evidence_type) == ("Aircraft X", "1970-01-01T00:01:40Z", "airborne", "AVIATION", "OBSERVED")
    assert facts(a) == {"icao24": "a1", "callsign": "X", "origin_country": "IN", "baro_altitude_m": 1.0, "velocity_m_s": 2.0, "track_deg": 90.0, "vertical_rate_m_s": 0.5}
    assert (b.title, b.start_time, b.status, facts(b)["callsign"]) == ("Aircraft a2", "1970-01-01T00:00:50Z", "on-ground", None)


def test_feed_of_weather(spark, tmp_path):
    city = {"name": "Pune", "state": "MH", "coordinates": [73.8, 18.5]}
    told = {"current": {"time": "2026-01-01T05:15", "temperature_2m": 21.4, "wind_speed_10m": 7}, "current_units": {"temperature_2m": "°C", "wind_speed_10m": "km/h"}}
    r = feeds.read(spark, "weather", write(tmp_path, "w.json", {"cities": [city, city], "response": [told]})).collect()
    assert [(x.record_id, x.title, x.start_time, x.status, x.evidence_type, x.lat) for x in r] == [("Pune-2026-01-01T05:15", "Pune: 21.4°C, wind 7 km/h", "2026-01-01T05:15:00Z", "model-analysis", "INFERRED", 18.5)]
    assert facts(r[0])["state"] == "MH" and facts(r[0])["temperature_2m"] == 21.4 and facts(r[0])["units"]["wind_speed_10m"] == "km/h"


def test_feeds_of_signals_launches_and_fires(spark, tmp_path):
    r = feeds.read(spark, "outages", write(tmp_path, "o.json", {"data": [{"datasource": "gtr", "start": 60, "duration": 60, "method": "m", "score": 1.0}]})).first()
    assert (r.record_id, r.title, r.end_time, r.scope, r.lon, r.status, r.evidence_type) == ("gtr-60", "Internet outage signal in India (Google Transparency Report traffic)", "1970-01-01T00:02:00Z", "national", None, "detected", "INFERRED")
    for k, kp in enumerate(([["station_count", "Kp", "time_tag"], ["8", "5.33", "2026-01-01 00:00:00"]], [{"time_tag": "2026-01-01T00:00:00", "Kp": 5.33, "station_count": 8}])):
        r = feeds.read(spark, "kp-index", write(tmp_path, f"k{k}.json", kp)).collect()
        assert [(x.title, x.status, x.start_time, x.scope, facts(x)["station_count"]) for x in r] == [("Planetary Kp 5.33 (storm level)", "observed", "2026-01-01T00:00:00Z", "global", "8")]
    launch = {"id": "l", "name": "PSLV", "net": "2026-03-01T00:00:00Z", "status": {"name": "Go for Launch", "abbrev": "Go"}, "net_precision": {"name": "Month"}, "pad": {"name": "FLP", "longitude": "80.2", "latitude": 13.7}}
    nowhere = {"id": "x", "name": "x", "pad": {"name": "y", "longitude": None, "latitude": None}}
    r = feeds.read(spark, "launches", write(tmp_path, "l.json", {"upcoming": {"results": [launch]}, "previous": {"results": [nowhere]}})).collect()
    assert [(x.record_id, x.status, x.evidence_type, x.lat, facts(x)["time_precision"], facts(x)["upcoming"]) for x in r] == [("l", "Go", "VERIFIED RECORD", 13.7, "Month", True)]
    fires = "latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp,daynight\n20.1,80.2,2026-01-01,5,N,VIIRS,h,3.5,N\n"
    r = feeds.read(spark, "fires", write(tmp_path, "f.csv", fires)).first()
    assert (r.record_id, r.title, r.start_time, r.status) == ("20.1-80.2-2026-01-01-0005-N", "Thermal anomaly (VIIRS, night)", "2026-01-01T00:05:00Z", "detected")
    assert facts(r) == {"frp_mw": 3.5, "source_confidence": "high", "satellite": "N", "bright_ti4_k": None}
    with pytest.raises(ValueError, match="no adapter"):
        feeds.read(spark, "nothing", "")


def test_vessel_contract(spark):
    rows = [("123456789", 1.0, 2.0, "2026-01-01T00:00:00Z", 360.0, 102.3, 511.0), ("12", 1.0, 95.0, "2026-01-01T00:00:00", 10.0, 1.0, 5.0)]
    good, bad = feeds.vessel_reports(spark.createDataFrame(rows, "identifier string, lon double, lat double, observed_at string, course_deg double, speed_kn double, heading_deg double"))
    assert [(r.course_deg, r.speed_kn, r.heading_deg) for r in good.collect()] == [(None, None, None)]
    assert len(bad.first().problems) == 3


def shapes():
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    pts = ring + hole
    body = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, len(pts), 0, len(ring)) + b"".join(struct.pack("<dd", *p) for p in pts)
    point = struct.pack("<idd", 1, 7.0, 8.0)
    shp = bytes(100) + b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate([body, struct.pack("<i", 0), point]))
    rows = [b" " + n.ljust(5).encode() + str(i).rjust(3).encode() for i, n in enumerate(["one", "two", "tre"])]
    field = lambda n, kind, w: n.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([w]) + bytes(15)
    dbf = struct.pack("<B3BIHH", 3, 26, 1, 1, 3, 32 + 64 + 1, 9) + bytes(20) + field("NAME", "C", 5) + field("N", "N", 3) + b"\x0d" + b"".join(rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.shp", shp)
        z.writestr("a.dbf", dbf)
    return out.getvalue()


def test_shapefiles(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(shapes())
    spark.dataSource.register(shapefile.ShapefileSource)
    for df in (shapefile.read(spark, str(tmp_path / "a.zip")), spark.read.format("zipped-shapefile").load(str(tmp_path / "a.zip"))):
        a, b = sorted(df.collect())
        assert json.loads(a.properties) == {"name": "one", "n": 0} and len(json.loads(a.geometry)["coordinates"]) == 2
        assert json.loads(b.properties)["name"] == "tre" and json.loads(b.geometry) == {"type": "Point", "coordinates": [7.0, 8.0]}


AREA = [[[(70.0, 10.0), (80.0, 10.0), (80.0, 20.0), (70.0, 20.0)]]]
EVENTS = "source_id string, record_id string, type string, category string, title string, start_time string, end_time string, status string, evidence_type string, lon double, lat double, scope string, attributes string"


def record(i, title="t", lon=75.0, lat=15.0, scope="spatial", start="2026-01-01T00:00:00Z"):
    return ("s", str(i), "flood", "c", title, start, None, None, "REPORTED", lon, lat, scope, "{}")


def test_ingest_is_idempotent(spark):
    rows = [record(1), record(2, lon=15.0, lat=75.0), record(3, "India", 15.0, 75.0), record(4, lat=95.0), record(5, start=None), record(6, "", scope="national"), record(7, lon=None, scope="global"), record(8, lon=None)]
    judged = ingest.judged(spark.createDataFrame(rows, EVENTS), AREA, "India")
    assert [(r.disposition, r.reason) for r in judged.orderBy("record_id").collect()] == [
        ("kept", None), ("outside", None), ("suspect-swap", None), ("invalid", "coordinate out of range"), ("invalid", "missing time"), ("invalid", "missing title"), ("kept", None), ("invalid", "missing geometry"),
    ]
    assert sum(r.n for r in ingest.counters(judged).collect()) == 8
    assert ingest.judged(spark.createDataFrame(rows[:1], EVENTS), None).first().disposition == "unscoped"
    old = spark.createDataFrame([], EVENTS.replace("record_id string", "id string, created_at string, updated_at string"))
    once = ingest.stored(old, judged, "t1").cache()
    twice = ingest.stored(once, judged, "t2")
    assert sorted((r.id, r.created_at, r.updated_at) for r in twice.collect()) == [("s:1", "t1", "t2"), ("s:7", "t1", "t2")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 1)], "id int, source_id string, v string, created_at int")
    new = spark.createDataFrame([(2, "b", "z", 2, 1), (2, "b", None, 2, 2), (3, "b", "w", 2, 3)], "id int, source_id string, v string, created_at int, n int")
    assert sorted(map(tuple, merge.upserted(old, new, order="n").collect())) == [(1, "a", "x", 1), (2, "a", None, 1), (3, "b", "w", 2)]
    assert merge.inserted(old, new.drop("n"), ["id"]).count() == 3
    assert merge.replaced_rows(old, new.drop("n").where("v = 'w'")).count() == 3
    assert {r.id for r in merge.rerun_kept(old, new.drop("n").where("v is not null"), F.col("v") == "y").collect()} == {2, 3}
    s = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "source_id string, stamp int")
    assert sorted(map(tuple, merge.retained(s, 2).collect())) == [("a", 3), ("a", 4), ("b", 1)]
    v = merge.superseded(spark.createDataFrame([(1, "current")], "v int, status string"), spark.createDataFrame([(2, "")], "v int, status string"))
    assert sorted(map(tuple, v.collect())) == [(1, "superseded"), (2, "current")]
    assert timeline.density(spark.createDataFrame([], "start_time string, end_time string, type string, category string"), "a", "b", []).count() == 0


def test_audit_chain(spark):
    rows, prev = [], governance.GENESIS
    for i in range(6):
        h = governance.entry_hash(prev, f"t{i}", "me", "look", None, None)
        rows.append((i, f"t{i}", "me", "look", None, None, prev, h))
        prev = h
    schema = "id int, at string, actor string, action string, target string, details string, prev_hash string, hash string"
    check = lambda r: [tuple(x) for x in governance.verified_chain(spark.createDataFrame(r, schema)).collect()]
    assert check(rows) == []
    assert check([*rows[:3], (99, *rows[2][1:]), *[(r[0] + 100, *r[1:]) for r in rows[3:]]]) == []
    assert check([*rows[:2], (2, "t2", "you", *rows[2][3:]), *rows[3:]]) == [(2, "altered row")]
    assert check(rows[:2] + rows[3:]) == [(3, "broken link")]


def test_metrics(spark):
    r = spark.createDataFrame([(1, 0.9, True), (2, 0.8, None), (3, 0.7, True)], "id int, s double, rel boolean").withColumn("g", F.lit("q"))
    assert evaluation.precision_at(r, 2, F.col("s"), F.col("rel")).first().precision == 0.5
    assert abs(evaluation.average_precision(r, "g", F.col("s"), F.col("rel")).first().average_precision - (1 + 2 / 3) / 2) < 1e-12
    empty = evaluation.binary_metrics(r.limit(0), F.col("rel"), F.col("rel")).first()
    assert empty.tp == 0 and empty.precision is None and empty.iou is None


def test_streams(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    schema = "id string, type string, ts timestamp, v int"
    put = lambda n, rows: (landing / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "type", "ts", "v"), r, strict=True))) for r in rows))
    put(1, [("a", "x", "2026-01-01T00:00:00", 1), ("a", "x", "2026-01-02T00:00:00", 2), ("b", "y", "2026-01-01T05:00:00", 3)])
    go = lambda: streaming.keep_latest(streaming.event_stream(spark, str(landing), schema), str(tmp_path / "t"), str(tmp_path / "c"), "id", "ts").awaitTermination()
    go()
    put(2, [("b", "y", "2026-01-03T00:00:00", 9), ("c", "x", "2025-01-03T00:00:00", 4)])
    go()
    go()
    got = streaming.current(spark, str(tmp_path / "t")).collect()
    assert sorted((r.id, r.v) for r in got) == [("a", 2), ("b", 9), ("c", 4)]
    stream = streaming.daily_counts(streaming.event_stream(spark, str(landing), schema))
    stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("days").collect()) == 5
    stale = streaming.flagged_stale(spark.read.schema(schema).json(str(landing)), "2026-01-03 00:00:00", 24.0, ["x"])
    assert stale.where("stale").count() == 2 and stale.count() == 5
    assert streaming.poll_seconds(4000) == 109.0 and streaming.poll_seconds(10**6) == 90.0 and streaming.backoff_seconds(1) == 90 and streaming.backoff_seconds(3) == 360 and streaming.backoff_seconds(9, retry_after=2000) == 2000


def test_manifests_and_sites(spark):
    m = {"a": 1, "b": [2]}
    m["content_sha256"] = evaluation.seal(m)
    assert evaluation.seal(m) == m["content_sha256"] and evaluation.seal(m | {"a": 2}) != m["content_sha256"]
    e = spark.createDataFrame([("1", "s", "x", "train"), ("2", "s", "x", "test"), ("3", "u", "x", "test"), ("4", "t", "y", "test")], "entry_id string, scene_id string, sha256 string, split string")
    s = spark.createDataFrame([("s", "x"), ("t", "x")], "id string, sha256 string")
    assert sorted(map(tuple, evaluation.manifest_problems(e, s).collect())) == [("1", "scene in several splits"), ("2", "scene in several splits"), ("3", "unknown scene"), ("4", "checksum differs")]
    labels = spark.createDataFrame([("a", True, ["t1"], "2020", "2022"), ("b", True, ["t2"], "2020", "2022"), ("c", False, ["t1"], "2019", "2022"), ("d", False, ["t9"], "2020", "2022")], "site_id string, changed boolean, tile_ids array<string>, first string, last string")
    found = spark.createDataFrame([(["t1", "t3"], "2020-05", "2021-01"), (["t2"], "2023-05", "2024-01")], "tile_ids array<string>, latest_before string, earliest_after string")
    assert sorted(map(tuple, evaluation.site_outcomes(labels, found).collect())) == [("a", "tp"), ("b", "fn"), ("c", "fp"), ("d", "tn")]


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "state")
    sink = streaming.merged_into(path, "id", "ts", buckets=16)
    rows = lambda r: spark.createDataFrame(r, "id int, ts int, v string")
    assert streaming.current(spark, path) is None
    sink(rows([(i, 1, "old") for i in range(200)]), 0)
    before = streaming.live(spark, path)
    assert len(before) == 16
    sink(rows([(3, 2, "new"), (3, 0, "late"), (500, 1, "more")]), 1)
    after = streaming.live(spark, path)
    assert 1 <= sum(after[b] != before[b] for b in after) <= 2
    state = {r.id: r.v for r in streaming.current(spark, path).collect()}
    assert len(state) == 201 and state[3] == "new" and state[4] == "old" and state[500] == "more"
    sink(rows([(3, 9, "again")]), 1)  # a batch that is run again
    assert {r.id: r.v for r in streaming.current(spark, path).collect()} == state
    # a version without its marker does not count, and is written over
    rows([(3, 9, "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/version=2")
    assert {r.id: r.v for r in streaming.current(spark, path).collect()} == state
    sink(rows([(3, 3, "next")]), 2)
    sink(rows([]), 3)
    assert {r.id: r.v for r in streaming.current(spark, path).collect()} == state | {3: "next"}
