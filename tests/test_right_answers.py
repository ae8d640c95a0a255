"""Cases whose answers are known from the rules: freshness, the audit chain, fusion, assignment, lines, seeds."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from orrery.functions.geo import simplified
from orrery.operators import clusters, governance, ingest, spatial, vectors


def test_freshness(spark):
    schema = "n int, adapter boolean, key_present boolean, health string, age_h double, stale_after_hours double, delayed_after_hours double"
    rows = [(0, True, True, "ok", 0.2, 1.0, None), (1, True, True, "offline-snapshot", 5.0, 1.0, None), (2, True, True, "failed", None, 1.0, None), (3, True, True, None, None, 1.0, None), (4, None, True, None, None, None, None), (5, True, False, None, None, None, None), (6, True, True, "rate-limited", 0.5, 1.0, 0.1), (7, True, True, "ok", 0.5, 1.0, 0.1)]
    got = {r.n: r for r in governance.freshness(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].state for i in range(8)] == ["LIVE", "STALE", "UNAVAILABLE", "NOT STAGED", "NOT IMPLEMENTED", "KEY REQUIRED", "SNAPSHOT", "DELAYED"]
    assert got[0].label == "LIVE · 12 min old" and got[1].label == "STALE · 5.0 h old" and got[6].label.endswith("RATE LIMITED") and got[2].label == "UNAVAILABLE"
    offline = governance.freshness(spark.createDataFrame(rows, schema), "airgapped").where("n in (0, 7)").collect()
    assert {r.state for r in offline} == {"SNAPSHOT"}


def test_entries_are_hashed_and_appended(spark):
    text = '["' + "0" * 64 + '","t","me","say",null,"{\\"a\\":\\"\\u00e9\\"}"]'
    details = json.dumps({"a": "é"}, ensure_ascii=False, separators=(",", ":"))
    assert governance.entry_hash(governance.GENESIS, "t", "me", "say", None, details) == hashlib.sha256(text.encode()).hexdigest()
    empty = spark.createDataFrame([], "id bigint, at string, actor string, action string, target string, details string, prev_hash string, hash string")
    entry = "at string, actor string, action string, target string, details string"
    one = governance.appended(empty, spark.createDataFrame([("2", "me", "b", None, None), ("1", "me", "a", "x", "{}")], entry))
    log = one.union(governance.appended(one, spark.createDataFrame([("3", "you", "c", None, None)], entry)))
    assert [(r.id, r.action) for r in log.orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert governance.verified_chain(log).count() == 0
    assert [tuple(r) for r in governance.verified_chain(log.withColumn("actor", F.when(F.col("id") == 2, "eve").otherwise(F.col("actor")))).collect()] == [(2, "altered row")]


def test_decisions_are_written_and_told(spark):
    c = spark.createDataFrame([("a", "unreviewed"), ("b", "confirm"), ("c", "unreviewed")], "id string, review_state string")
    d = spark.createDataFrame([(1, "a", "reject", "me", "t1", None), (2, "a", "confirm", "me", "t2", "sure")], "id int, target_id string, decision string, actor string, at string, note string")
    assert sorted(map(tuple, governance.decided(c, d).collect())) == [("a", "confirm"), ("b", "confirm"), ("c", "unreviewed")]
    assert [r.details for r in governance.decision_entries(d).orderBy("at").collect()] == [None, '{"note":"sure"}']


def test_related_events_have_text_ids(spark):
    changes = spark.createDataFrame([("c1", 75.0, 15.0), ("c2", 0.0, 0.0)], "id string, lon double, lat double")
    events = spark.createDataFrame([("quakes:q1", 75.1, 15.0), ("quakes:q2", 75.2, 15.0)], "id string, lon double, lat double")
    got = {r.id: [x.b for x in r.related] for r in spatial.related(changes, events).collect()}
    assert got == {"c1": ["quakes:q1", "quakes:q2"], "c2": []}


def test_assignment_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "x", [1.0, 0.0])] * 2 + [(1, "y", [0.0, 1.0])], "family int, id string, embedding array<double>")
    centres = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.5), (1, 2, [1.0, 0.0], 0.5)], "family int, cluster int, centroid array<double>, radius double")
    got = sorted((r.id, r.nearest, r.cluster) for r in vectors.assigned(rows, centres, ["family"]).select("id", "nearest", F.coalesce("cluster", F.lit(0)).alias("cluster")).collect())
    assert got == [("x", 1, 1), ("x", 1, 1), ("y", 1, 0)]


def test_lines_are_simplified_by_the_line_through_their_ends():
    # the second point lies on the line through the ends, but beyond them
    assert simplified([(0.0, 0.0), (-5.0, 0.0), (1.0, 0.0)], 0.1) == [(0.0, 0.0), (1.0, 0.0)]
    assert simplified([(0.0, 0.0), (3.0, 4.0), (0.0, 0.0)], 4.9) == [(0.0, 0.0), (3.0, 4.0), (0.0, 0.0)]


def test_small_families_try_two_clusters():
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]])
    k, labels, _, s = clusters.chosen(x)
    assert k == 2 and labels[0] == labels[1] != labels[2] == labels[3] and s > 0.99


def test_the_last_record_of_a_batch_wins(spark):
    old = spark.createDataFrame([], "source_id string, title string, id string, created_at string, updated_at string")
    batch = spark.createDataFrame([("s", "1", f"v{i}", "kept", None) for i in range(50)], "source_id string, record_id string, title string, disposition string, reason string").repartition(1)
    got = ingest.stored(old, batch.coalesce(1), "now").collect()
    last = batch.coalesce(1).collect()[-1].title
    assert [(r.id, r.title) for r in got] == [("s:1", last)]
