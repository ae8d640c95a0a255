import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from orrery import schemas
from orrery.operators import imagery
from orrery.sources import rasters


def tiff(epsg=32644):
    entries = [(256, 3, 1, struct.pack("<HH", 40, 0)), (257, 3, 1, struct.pack("<HH", 30, 0)), (258, 3, 1, struct.pack("<HH", 16, 0)), (277, 3, 1, struct.pack("<HH", 6, 0))]
    extra, base = b"", 8 + 2 + 12 * 7 + 4
    for tag, kind, values, code in ((33550, 12, (10.0, 10.0, 0.0), "d"), (33922, 12, (0, 0, 0, 500000.0, 2000000.0, 0), "d"), (34735, 3, (1, 1, 0, 1, 3072, 0, 1, epsg), "H")):
        data = struct.pack(f"<{len(values)}{code}", *values)
        entries.append((tag, kind, len(values), struct.pack("<I", base + len(extra))))
        extra += data
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + bytes(4) + extra


def test_headers(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff())
    (tmp_path / "b.tiff").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"")
    a, b = sorted(rasters.inspected(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert (a.width, a.height, a.bands, a.bits, a.epsg, a.origin_x, a.pixel_y, a.problem) == (40, 30, 6, 16, 32644, 500000.0, 10.0, None)
    assert b.problem.startswith("unreadable")


def test_archives_catalogues_snapshots(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/plants.csv", "name,country,mw\nA,IND,5\nB,,\n")
    (tmp_path / "p.zip").write_bytes(out.getvalue())
    rows = rasters.zipped_csv(spark, str(tmp_path / "p.zip"), "plants.csv", ["name", "country"]).collect()
    assert [tuple(r) for r in rows] == [("A", "IND"), ("B", None)]
    good = {a: {"href": "x"} for a in rasters.ASSETS}
    item = lambda i, t, assets: {"id": i, "bbox": [0, 0, 2, 2], "properties": {"datetime": t, "eo:cloud_cover": 5.0, "proj:epsg": 32644, "s2:processing_baseline": "05.00"}, "assets": assets}
    (tmp_path / "c.json").write_text(json.dumps({"features": [item("a", "2026-01-01T00:00:00Z", good), item("b", None, good), item("c", "2026-01-01T00:00:00Z", {})]}))
    c = rasters.catalogue(spark, str(tmp_path / "c.json"))
    assert [(r.id, r.reason) for r in c.orderBy("id").collect()] == [("a", None), ("b", "no time"), ("c", "assets missing")]
    assert c.where(rasters.covers(F.col("bbox"), 0.5, 0.5, 1.5, 1.5)).count() == 3
    for s in ("1", "2", "3"):
        (tmp_path / "snap" / "quakes").mkdir(parents=True, exist_ok=True)
        (tmp_path / "snap" / "quakes" / f"{s}.json").write_text("x")
    found = rasters.snapshots(spark, str(tmp_path / "snap"))
    assert rasters.latest_snapshot(found).first().path.endswith("3.json")
    assert [r.stamp for r in rasters.superfluous(found, 2).collect()] == ["1"]


def test_scenes_and_pairs(spark):
    s = spark.createDataFrame([("a", "x", "2018-01-03", "g", "usable", "f", 0.0), ("b", "x", "2026-02-03", "g", "degraded", "f", None), ("c", "x", "2026-07-03", "g", "rejected", "f", 0.0)], "id string, aoi_id string, acquired_at string, grid string, quality_status string, file string, offset double")
    assert [r.reason for r in imagery.ineligible(s).orderBy("id").collect()] == [None, "offset unknown", "quality is rejected"]
    assert [(r.before, r.after, r.years) for r in imagery.suggested(s).collect()] == [("a", "b", 8)]
    one = F.struct("aoi_id", "acquired_at", "grid")
    p = s.where("id = 'c'").select(one.alias("before")).join(s.where("id = 'a'").select(one.alias("after")), F.lit(True)).withColumns({"shift_px": F.lit(0.7), "joint_clear": F.lit(0.4)})
    r = imagery.admissible(p).first()
    assert r.problems == ["not in order of time", "too few clear pixels"] and r.warnings == ["different seasons", "slightly shifted"]
    w = imagery.chip_windows(spark.createDataFrame([("a", 480, 450)], "id string, height int, width int")).groupBy("chip_px").count().collect()
    assert {(r.chip_px, r["count"]) for r in w} == {(224, 9), (112, 25)}
    items = spark.createDataFrame([("a", "2026-01-01", True, 5.0, 1), ("b", "2026-01-09", True, 1.0, 1), ("c", "2026-02-01", False, 0.0, 1)], "id string, acquired_at string, covers boolean, cloud double, version int")
    assert [r.id for r in imagery.best_of_month(items, s.limit(0), 1).orderBy("month").collect()] == ["b", "c"]
    st = spark.createDataFrame([(True, 5, 5, False), (True, 5, 2, False), (False, 5, 0, False), (True, 5, 2, True)], "m boolean, e int, i int, r boolean")
    assert [r.s for r in st.select(imagery.retrieval_state(*[F.col(c) for c in "meir"]).alias("s")).collect()] == ["READY", "PARTIAL", "NOT STAGED", "INDEXING"]


def test_schemas(spark):
    for name in schemas.TABLES:
        assert schemas.migrated(spark.createDataFrame([(1, "x")], "id int, extra string"), name).schema == spark.createDataFrame([], schemas.schema(name)).schema
    bad = spark.createDataFrame([(None, "m", "guess", 2.0, [])], "capability string, model string, kind string, confidence double, evidence array<string>")
    assert len(bad.select(rasters.output_problems().alias("p")).first().p) == 4


def test_pixels_uses_and_overlaps(spark, tmp_path):
    import zlib

    import numpy as np

    from orrery.operators import raster

    a = np.arange(2 * 3 * 2, dtype="<u2").reshape(2, 3, 2)
    for name, packing in (("p", 1), ("d", 8)):
        strips = [a[i].tobytes() if packing == 1 else zlib.compress(a[i].tobytes()) for i in range(2)]
        base, n = 8 + 2 + 12 * 7 + 4, 7
        offsets = struct.pack("<II", base + 16, base + 16 + len(strips[0]))
        sizes = struct.pack("<II", *map(len, strips))
        entries = [(256, 3, 1, struct.pack("<HH", 3, 0)), (257, 3, 1, struct.pack("<HH", 2, 0)), (258, 3, 1, struct.pack("<HH", 16, 0)), (259, 3, 1, struct.pack("<HH", packing, 0)), (273, 4, 2, struct.pack("<I", base)), (277, 3, 1, struct.pack("<HH", 2, 0)), (279, 4, 2, struct.pack("<I", base + 8))]
        data = b"II*\0" + struct.pack("<IH", 8, n) + b"".join(struct.pack("<HHI", t, k, c) + v for t, k, c, v in entries) + bytes(4) + offsets + sizes + b"".join(strips)
        assert np.array_equal(rasters.pixels(data), a)
        (tmp_path / f"{name}.tif").write_bytes(data)
    (tmp_path / "x.tif").write_bytes(b"no")
    rows = rasters.raster_rows(spark, str(tmp_path)).collect()
    assert sum(r.problem is not None for r in rows) == 1 and len(rows) == 9
    assert sorted((r.band, r.row, r.values) for r in rows if r.path.endswith("d.tif"))[1] == (0, 1, [6.0, 8.0, 10.0])
    (tmp_path / "g.tif").write_bytes(tiff())
    u = {r.path[-5:]: r for r in rasters.uses(rasters.inspected(spark, str(tmp_path))).collect()}
    assert u["g.tif"].change == "SUPPORTED" and u["p.tif"].display.startswith("NOT COMPATIBLE")
    headers = rasters.inspected(spark, str(tmp_path))
    assert rasters.unregistered(headers, headers.where("path like '%g.tif'").select("sha256")).count() == 3
    px = spark.createDataFrame([("r", 1, 5, 5), ("r", 1, 15, 5), ("r", 2, 95, 5)], "run_id string, region int, row int, col int")
    t = spark.createDataFrame([("c", 0, 0), ("c", 1, 0)], "candidate string, tile_row bigint, tile_col bigint")
    assert [tuple(r) for r in raster.overlaps(px, t).collect()] == [("r", 1, "c", 2)]
