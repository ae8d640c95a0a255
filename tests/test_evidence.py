import pytest

from orrery.operators import clusters, evidence, gazetteer


def test_ledger_counts_failures_since_the_last_success(spark):
    rows = [
        ("a", 1, 100, 110, "failed", "x", None), ("a", 2, 200, 210, "success", None, None), ("a", 3, 300, 310, "failed", "y", 60), ("a", 4, 400, 410, "offline-snapshot", None, None), ("a", 5, 500, 510, "failed", "z", None),
        ("b", 1, 100, 110, "failed", "x", 30), ("b", 2, 200, 210, "success", None, None), ("c", 1, 100, 110, "failed", "q", 5), ("d", 1, 100, 110, "offline-snapshot", None, None),
    ]
    runs = spark.createDataFrame(rows, "source_id string, run int, started_at bigint, finished_at bigint, status string, error string, retry_after_s bigint")
    got = {r.source_id: tuple(r)[1:] for r in evidence.run_ledger(runs.repartition(3)).collect()}
    assert got == {
        "a": (2, 200, 500, "z", "failed", 370), "b": (0, 200, 100, None, "ok", None), "c": (1, None, 100, "q", "rate-limited", 115), "d": (0, None, None, None, "offline-snapshot", None),
    }
    assert evidence.run_ledger(runs.where("false")).count() == 0


def test_scenes_and_tiles_of_candidates(spark):
    c = spark.createDataFrame([("c1", ["s2", "s1", "s2", "gone"], "2024-01-01", "2024-02-01", ["t1", "t2"]), ("c2", [], "2024-01-01", None, ["t2", "t2"])], "id string, supporting_scene_ids array<string>, last_clean_before string, earliest_supported_after string, tile_ids array<string>")
    scenes = spark.createDataFrame([("s1", "2024-01-01T05:00:00Z", "usable"), ("s2", "2024-02-01T05:00:00Z", "degraded"), ("s3", "2024-01-01T05:00:00Z", "usable")], "id string, acquired_at string, quality_status string")
    a, b = evidence.candidate_scenes(c, scenes).orderBy("id").collect()
    assert [s.id for s in a.scenes] == ["s1", "s2"] and (a.evidence_before.id, a.evidence_after.quality_status) == ("s1", "degraded")
    assert b.scenes is None and b.evidence_before is None
    tiles = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tile_id string")
    assert sorted(map(tuple, evidence.candidates_of_tiles(tiles, c).collect())) == [("t1", "c1"), ("t2", "c1"), ("t2", "c2")]


def chips(spark):
    rows = [
        ("e", "a", 100, 0, 0, "2024-01", [1.0, 0.0]), ("near", "a", 100, 0, 40, "2024-01", [0.9, 0.1]), ("far", "a", 100, 0, 60, "2024-02", [0.8, 0.6]), ("far-late", "a", 100, 0, 60, "2024-03", [1.0, 0.0]),
        ("other-area", "b", 100, 0, 0, "2024-02", [0.6, 0.8]), ("small", "b", 50, 0, 0, "2024-02", [1.0, 0.0]), ("not", "b", 100, 500, 0, "2024-02", [0.0, 1.0]),
    ]
    return spark.createDataFrame(rows, "id string, aoi_id string, chip_px int, row_off int, col_off int, acquired_at string, embedding array<double>")


def test_similar_chips_by_scope(spark):
    c = chips(spark)
    ids = lambda **how: [r.id for r in evidence.similar_chips(c, ["e"], **how).orderBy("rank").collect()]
    assert ids() == ["far-late", "other-area", "not"]  # 40 columns of 100 are shared with far: another place; one date of it
    assert ids(scope="same-place") == ["near"]
    assert ids(scope="all", limit=2) == ["far-late", "near"] and ids(end="2024-02") == ["far", "other-area", "not"]
    assert ids(negatives=["not"]) == ["far-late", "other-area"]
    assert evidence.similar_chips(c, ["e"], scope="same-place").first().same_place
    with pytest.raises(ValueError, match="not indexed"):
        evidence.similar_chips(c, ["e", "lost"])
    with pytest.raises(ValueError, match="scope"):
        evidence.similar_chips(c, ["e"], scope="here")


def test_discovery_takes_a_members_own_cluster_first(spark):
    clusters = spark.createDataFrame([(64, 1, [1.0, 0.0]), (64, 2, [0.0, 1.0])], "family int, cluster int, centroid array<double>")
    members = spark.createDataFrame([("m", 2), ("u", None)], "id string, cluster int")
    refs = spark.createDataFrame([("m", 64, [1.0, 0.0]), ("u", 64, [0.1, 0.9]), ("n", 64, [0.7, 0.7]), ("x", 32, [1.0, 0.0])], "id string, family int, embedding array<double>")
    got = {r.reference: (r.cluster, r.membership) for r in evidence.discovered_by_reference(refs, members, clusters).collect()}
    assert got == {"m": (2, evidence.MEMBER), "u": (2, evidence.UNASSIGNED), "n": (1, evidence.NEWER), "x": (None, evidence.NEWER)}


def test_names_as_a_scan_finds_them(spark):
    import random

    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n)).strip()
    places = [(i, word(rnd.randint(1, 9)) or "a", rnd.choice(["city", "state", "district", "other"]), rnd.choice([None, 5, 9])) for i in range(300)]
    questions = [(i, word(rnd.randint(0, 5))) for i in range(120)]
    p = spark.createDataFrame([(i, k, kind, n, k.title()) for i, k, kind, n in places], "place_id int, key string, kind string, population int, name string")
    got = {}
    for r in gazetteer.found(spark.createDataFrame(questions, "question_id int, key string"), p, gazetteer.postings(p), 7).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append((r.fit, r.place_id))
    for q, asked in questions:
        fits = [(0 if k == asked else 1 if k.startswith(asked) else 2, gazetteer.KIND_ORDER.get(kind, 3), -(n or 0), k.title(), i) for i, k, kind, n in places if asked and asked in k]
        assert got.get(q, []) == [(x[0], x[-1]) for x in sorted(fits)[:7]]


def test_names_that_many_places_share(spark):
    names = ["red bolt", "red ring", "old gear", "bolt"]
    places = [(i, names[i % 4], ["city", "state", "other"][i % 3], i % 5 or None, names[i % 4].title()) for i in range(400)]
    p = spark.createDataFrame(places, "place_id int, key string, kind string, population int, name string")
    questions = [(i, ["red", "bolt", "e", "old gear", "x"][i % 5]) for i in range(300)]
    index = gazetteer.postings(p)
    assert index.count() == gazetteer.postings(p.limit(4)).count() == index.distinct().count()  # a name once, not once for each place
    got = {}
    for r in gazetteer.found(spark.createDataFrame(questions, "question_id int, key string"), p, index, 6).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.place_id, r.fit))
    for q, asked in questions:
        fits = sorted((0 if k == asked else 1 if k.startswith(asked) else 2, gazetteer.KIND_ORDER.get(kind, 3), -(n or 0), name, i) for i, k, kind, n, name in places if asked in k)
        assert got.get(q, []) == [(n, x[-1], x[0]) for n, x in enumerate(fits[:6], 1)]


def test_digest_as_a_tree(spark):
    rows = [(i, [float(i), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert clusters.fingerprint(df, each=10) == clusters.fingerprint(df.repartition(7).orderBy("embedding"), each=10) != clusters.fingerprint(df.limit(399), each=10)
    assert clusters.fingerprint(df.where("false")) == clusters.fingerprint(df.where("id < 0"))
    other = spark.createDataFrame([*rows[:7], (7, [7.0, 2.0]), *rows[8:], (999, [0.0, 0.0])], "id int, embedding array<double>")
    changed = {r.leaf for r in clusters.changed_ranges(df, other).collect()}
    of = lambda frame, i: clusters.leaves(frame.where(f"id = {i}")).first().leaf
    assert changed == {of(df, 7), of(other, 999)} and clusters.fingerprint(df) != clusters.fingerprint(other)
    assert clusters.changed_ranges(df, df.repartition(3)).count() == 0
