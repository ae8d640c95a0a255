import math
import random

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import geo, rules, text, vector
from orrery.operators import clusters, raster, spatial
from orrery.sinks import files


def test_polygons_with_holes(spark):
    square, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
    ring = lambda ps: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ps])
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (None, 1.0)], "lon double, lat double")
    got = pts.select(geo.in_multipolygon(F.col("lon"), F.col("lat"), F.array(F.array(ring(square), ring(hole)))).alias("i")).collect()
    assert [r.i for r in got] == [True, False, False, False]
    areas = spark.createDataFrame([("a",)], "area string").withColumn("polygons", F.array(F.array(ring(square), ring(hole))))
    assert spatial.inside_areas(pts, areas).count() == 1
    r = spark.range(1).select(geo.polygon_area(F.array(ring(square), ring(hole))).alias("a"), geo.ring_length(ring(square)).alias("l")).first()
    assert (r.a, r.l) == (96.0, 40.0)


def test_proximity_is_as_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.choice([rnd.uniform(-180, 180), 179.99, -179.99]), rnd.uniform(-80, 80)) for i in range(400)]
    df = spark.createDataFrame(pts, "id bigint, lon double, lat double")
    got = {(r.a, r.b) for r in spatial.proximity(df, df, 500_000.0, keep_self=False).collect()}
    rad = np.radians(np.array([(x, y) for _, x, y in pts]))
    d = lambda i, j: 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(math.sin((rad[j][1] - rad[i][1]) / 2) ** 2 + math.cos(rad[i][1]) * math.cos(rad[j][1]) * math.sin((rad[j][0] - rad[i][0]) / 2) ** 2))
    assert got == {(i, j) for i in range(400) for j in range(400) if i != j and d(i, j) <= 500_000.0}


def test_projections_and_lines(spark):
    p = spark.createDataFrame([(81.6, 21.25)], "lon double, lat double")
    r = p.select(geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 44).alias("u")).select("u.*", geo.utm_to_lonlat(F.col("u.easting"), F.col("u.northing"), 44).alias("b")).first()
    assert abs(r.b.lon - 81.6) < 1e-8 and abs(r.b.lat - 21.25) < 1e-8 and 500_000 < r.easting < 600_000
    assert geo.simplified([(0, 0), (1, 0.001), (2, 0), (2, 2)], 0.01) == [(0, 0), (2, 0), (2, 2)]
    got = spark.sql("select array(struct(0d as x, 0d as y), struct(1d as x, 0.001d as y), struct(2d as x, 0d as y)) as line").select(geo.simplify_line("line", F.lit(0.01)).alias("s")).first().s
    assert len(got) == 2
    w = spark.createDataFrame([(480,), (100,), (224,)], "n int").select(geo.window_offsets(F.col("n"), 224).alias("w")).collect()
    assert [r.w for r in w] == [[0, 128, 256], [], [0]]


def test_text(spark):
    assert text.fold_text("Île-de  São, 5") == "ile de sao 5" and text.fold_text(None) is None
    d = spark.createDataFrame([("within 2.5 km, magnitude 4+",), ("200 m above 5",), (None,)], "t string")
    got = d.select(text.distance_m(F.col("t")).alias("d"), text.min_magnitude(F.col("t")).alias("m"), text.fold("t").alias("f")).collect()
    assert [(r.d, r.m) for r in got] == [(2500.0, 4.0), (200.0, 5.0), (None, None)]
    r = spark.range(1).select(text.tile_parts(F.lit("a:b:3:4")).alias("p"), text.human_age(F.lit(50.0)).alias("a"), text.latlon_text(F.lit(-1.5), F.lit(2.0)).alias("l"), text.bearing_text(F.lit(359.7)).alias("b")).first()
    assert (r.p.aoi, r.p.row, r.p.col, r.a, r.l, r.b) == ("a:b", 3, 4, "2.1 d", "2.0000° N 1.5000° W", "000°")


def test_rules_and_vectors(spark):
    p = spark.createDataFrame([(0.1, 0.05, 0.04, 0.02, 6), (0.05, 0.05, 0.4, 0.2, 4), (0.2, 0.25, 0.3, 0.3, 4), (0.2, 0.2, 0.3, 0.3, 9)], "g double, r double, n double, s double, scl int")
    assert [r.c for r in p.select(rules.pixel_class(*[F.col(c) for c in ("g", "r", "n", "s", "scl")]).alias("c")).collect()] == ["water", "vegetation", "open", None]
    v = spark.createDataFrame([([0.6, 0.8],), ([1.0],), ([float("nan"), 0.0],), ([2.0, 0.0],)], "v array<double>")
    assert [r.x for r in v.select(vector.invalid_reason(F.col("v"), 2).alias("x")).collect()] == [None, "wrong length", "not finite", "not unit length"]
    z = vector.standardised(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]


def test_clusters_find_planted_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(36):
        v = np.eye(8)[i % 3] + rng.normal(0, 0.01, 8)
        rows.append((1, f"c{i:02d}", [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "family int, id string, embedding array<double>")
    got = clusters.built(df).collect()
    assert len({(int(r.id[1:]) % 3, r.cluster) for r in got}) == 3 and {r.cluster for r in got} == {1, 2, 3}
    assert got[0].silhouette > 0.9
    assert clusters.fingerprint(df) == clusters.fingerprint(df.repartition(5))
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "a int, b int")
    assert abs(clusters.rand_index(pairs, "a", "b").first().rand_index - 3 / 6) < 1e-12
    x = np.array([r[2] for r in rows])
    labels = np.arange(36) % 3
    d = 1 - x @ x.T
    want = np.mean([(lambda a, b: (b - a) / max(a, b))(d[i][(labels == labels[i]) & (np.arange(36) != i)].mean(), min(d[i][labels == c].mean() for c in range(3) if c != labels[i])) for i in range(36)])
    assert abs(clusters.silhouette(x, labels) - want) < 1e-9


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.random((80, 90))
    dr, dc = raster.shift(a, np.roll(a, (3, -2), (0, 1)))
    assert abs(dr - 3) < 0.3 and abs(dc + 2) < 0.3
    mask = np.zeros((6, 7), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = mask[5, 6] = True
    labels = raster.regions(mask)
    assert labels[0, 0] == labels[2, 2] == 1 and labels[5, 6] == 2 and labels.max() == 2 and (labels > 0).sum() == 4
    before, after = np.zeros((100, 130)), np.zeros((100, 130))
    after[20:40, 50:70] = 1
    pairs = spark.createDataFrame([("p", 100, 130, before.ravel().tolist(), after.ravel().tolist(), [True] * 13000)], "run_id string, height int, width int, before array<double>, after array<double>, valid array<boolean>")
    r = raster.changed_regions(pairs, lambda x, y: np.abs(y - x)).collect()
    assert [(x.pixels, x.row0, x.col0, x.small) for x in r] == [(400, 20, 50, False)]
    px = spark.range(400).select(F.lit("s").alias("scene_id"), F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), *[F.lit(0.1).alias(b) for b in ("b02", "b03", "b04")], F.lit(0.4).alias("b08"), F.lit(0.2).alias("b11"), F.when(F.col("id") % 20 < 5, 9).otherwise(4).alias("scl"))
    t = {(x.tile_row, x.tile_col): x for x in raster.tile_summaries(px, 20, 20).collect()}
    assert len(t) == 4 and t[0, 0].valid_fraction == 0.5 and t[0, 1].vegetation == 1.0
    assert raster.scene_quality(px).first().quality_status == "degraded" and raster.dark_pixels(px).first().n == 300
    assert files.png(np.zeros((2, 3, 3), np.uint8)).startswith(b"\x89PNG")
    import sqlite3

    files.geopackage(str(tmp_path / "x.gpkg"), {"events": [{"lon": 1.0, "lat": 2.0, "id": "a"}, {"lon": None, "lat": None, "id": "b"}], "none": []})
    with sqlite3.connect(tmp_path / "x.gpkg") as db:
        assert db.execute("select min_x, max_y from gpkg_contents where table_name = 'events'").fetchone() == (1.0, 2.0)
        assert db.execute("select count(*) from events where geom is not null").fetchone() == (1,)


def test_rounding_of_exact_doubles(spark):
    from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
    import random

    rnd = random.Random(4)
    values = [0.15, 1.65, 1.95, 0.25, 0.35, 2.5, 0.05, 0.0, 1e9 + 0.05, *[rnd.randrange(10**6) / rnd.choice([20, 200, 1000, 7]) for _ in range(3000)]]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", *[text.fixed(F.col("v"), d, e).alias(f"f{d}{e}") for d in (0, 1, 2) for e in (False, True)]).collect()
    for r in got:
        for d in (0, 1, 2):
            for e in (False, True):
                want = Decimal(r.v).quantize(Decimal(1).scaleb(-d), ROUND_HALF_EVEN if e else ROUND_HALF_UP)
                assert r[f"f{d}{e}"] == str(want), (r.v, d, e)
    sizes = spark.range(1).select(text.human_area(F.lit(1500.0)).alias("a"), text.human_distance(F.lit(1650.0)).alias("b"), text.human_distance(F.lit(1950.0)).alias("c")).first()
    assert tuple(sizes) == ("0.1 ha", "1.6 km", "1.9 km")
