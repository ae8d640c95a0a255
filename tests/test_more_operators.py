"""Ports, plants and layers; clustering versions and discovery; neighbours in growing circles."""

import io
import json
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import clusters, spatial, vectors
from orrery.sources import feeds


def test_power_plants(spark, tmp_path):
    table = "country,country_long,name,gppd_idnr,capacity_mw,latitude,longitude,primary_fuel,commissioning_year,owner,source,geolocation_source,year_of_capacity_data\nIND,India,Alpha,IND1,12.5,20.5,75.5,Coal,,,CEA,WRI,2019\nUSA,United States,Beta,USA1,1,2,3,Gas,,,,,\n"
    with zipfile.ZipFile(tmp_path / "plants.zip", "w") as z:
        z.writestr("folder/global.csv", table)
    rows = feeds.read(spark, "power-plants", str(tmp_path / "plants.zip")).collect()
    assert [(r.record_id, r.type, r.name, r.lon, r.lat) for r in rows] == [("IND1", "power-plant", "Alpha", 75.5, 20.5)]
    assert json.loads(rows[0].attributes) == {"primary_fuel": "Coal", "capacity_mw": 12.5, "capacity_data_year": 2019.0, "geolocation_source": "WRI", "original_source": "CEA"}


def archive(path, shapes, names):
    body = b"".join(struct.pack(">ii", i + 1, len(s) // 2) + s for i, s in enumerate(shapes))
    shp = struct.pack(">i5ii", 9994, *[0] * 5, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 0, *[0.0] * 8) + body
    head = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14
    dbf = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(names), 32 + 32 + 1, 21) + head + b"\r" + b"".join(b" " + n.encode().ljust(20) for n in names)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.shp", shp)
        z.writestr("a.dbf", dbf)
    path.write_bytes(out.getvalue())


def line(*points):
    xs, ys = zip(*points, strict=True)
    return struct.pack("<i4dii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)


def test_ports_and_layers(spark, tmp_path):
    archive(tmp_path / "ports.zip", [struct.pack("<i2d", 1, 72.8, 18.9), struct.pack("<i2d", 1, 80.3, 13.1)], ["Mumbai", ""])
    assert [(r.record_id, r.name, r.lon) for r in feeds.read(spark, "ports", str(tmp_path / "ports.zip")).orderBy("record_id").collect()] == [("Mumbai-0", "Mumbai", 72.8), ("Unnamed port 1-1", "Unnamed port 1", 80.3)]
    archive(tmp_path / "rivers.zip", [line((75.0, 15.0), (75.5, 15.001), (76.0, 15.0)), line((0.0, 0.0), (1.0, 1.0))], ["Inside", "Outside"])
    got = feeds.layer(spark, str(tmp_path / "rivers.zip"), 70, 8, 97, 37).collect()
    assert [(json.loads(r.properties)["name"], [[tuple(q) for q in one] for one in r.lines]) for r in got] == [("Inside", [[(75.0, 15.0), (76.0, 15.0)]])]


def test_versions_and_discovery(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        v = np.eye(3)[i % 3] + 0.05 * rng.normal(size=3)
        rows.append((64, f"c{i:02d}", (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "family int, id string, embedding array<double>")
    name, members, found = clusters.version(df, 3)
    assert name == clusters.version(df.repartition(5), 3)[0] and name.startswith("v003-")
    assert sum(r["size"] for r in found.collect()) == 60 and all(r.radius <= 1 for r in found.collect())
    about = members.withColumns({"place": F.col("id").substr(2, 1), "acquired_at": F.lit("2024-01-01")})
    hit = clusters.discovered(spark.createDataFrame([(64, [1.0, 0.0, 0.0])], "family int, embedding array<double>"), found, about, ["family"], ["place"])
    inside = [r for r in members.collect() if r.cluster == hit.first().cluster]
    assert sum(r.n for r in hit.collect()) == len(inside) and all(int(r.id[1:]) % 3 == 0 for r in inside)
    assert clusters.discovered(spark.createDataFrame([(64, [-1.0, 0.0, 0.0])], "family int, embedding array<double>"), found, about, ["family"], ["place"]).count() == 0


@pytest.mark.parametrize("direct", [0, 200])
def test_neighbours_in_growing_circles(spark, monkeypatch, direct):
    monkeypatch.setattr(spatial, "DIRECT", direct)
    rnd = random.Random(4)
    rows = [(i, i % 3, rnd.uniform(-180, 180) if i % 4 else 77.0, rnd.uniform(-80, 80) if i % 4 else 12.0) for i in range(150)] + [(900, 9, 0.0, 0.0), (901, 9, 179.9, 0.0), (902, 8, 1.0, 1.0), (903, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, kind int, lon double, lat double")

    def far(a, b):
        p, q = np.radians(a[3]), np.radians(b[3])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_008.8 * np.arcsin(np.sqrt(h))

    placed = [r for r in rows if r[2] is not None]
    want = {}
    for a in placed:
        best = sorted((round(far(a, b), 3), b[0]) for b in placed if b[0] != a[0] and b[1] == a[1])[:4]
        want |= {(a[0], i + 1): d for i, (d, _) in enumerate(best)}
    got = {(r.a, r["rank"]): r.distance_m for r in spatial.nearest_of_kind(df, "id", "kind", 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 0.01 for x in want)
    changes = spark.createDataFrame([("x", 1, 10.0, 10.0), ("x", 1, 10.0, 10.0), ("y", 2, 0.0, 0.0), ("z", 3, 0.0, 0.0)], "id string, aoi_id int, lon double, lat double")
    water = spark.createDataFrame([(1, 10.0, 11.0), (1, -170.0, -10.0), (2, 179.0, 0.0), (9, 0.0, 0.0)], "aoi_id int, lon double, lat double")
    got = sorted((r.id, round(r.water_m / 1000)) for r in spatial.water_distance(changes, water).collect())
    assert got == [("x", 111), ("x", 111), ("y", 19904)]
    assert {r.id for r in spatial.water_distance(changes, water, 200_000).collect()} == {"x"}


def test_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    x = np.random.default_rng(1).normal(size=(200, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    got = {}
    for r in vectors.nearest_rows(df, df.where("id % 20 = 0"), 7).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id))
    for q in range(0, 200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [i for _, i in sorted(got[q])] == np.argsort(-s, kind="stable")[:7].tolist()


def test_nearest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 100)
    monkeypatch.setattr(vectors, "SCORES", 4096)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[150:] = np.round(x[150:])  # copies and ties
    x[5] *= 1e18
    x[6] *= 1e-30
    x[7], x[8, 0], x[9, 1] = 0, np.nan, np.inf
    place = rng.integers(0, 3, 300)
    place[:100] = 1
    df = spark.createDataFrame([(i, v.tolist(), int(p)) for i, (v, p) in enumerate(zip(x, place, strict=True))], "id int, embedding array<double>, place int")
    got = {}
    for r in vectors.nearest_by(df, df, 7, "embedding", [None, "place"]).collect():
        got.setdefault((r.query, r.apart), []).append((r["rank"], r.id, r.score))
    for q in range(300):
        with np.errstate(invalid="ignore"):
            score = np.cumsum(x * x[q], axis=1)[:, -1]  # as SQL adds: to the last bit
        for apart, barred in enumerate((np.arange(300) == q, place == place[q])):
            best = sorted((-score[i], i) for i in range(300) if not barred[i] and score[i] > -np.inf)[:7]
            assert sorted(got.get((q, apart), [])) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
