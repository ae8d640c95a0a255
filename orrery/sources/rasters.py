"""Rasters at rest: GeoTIFF headers, catalogue items, snapshots of feeds."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.governance import contract_problems
from orrery.operators.merge import retained

HEADER = "path string, sha256 string, width int, height int, bands int, bits int, epsg int, origin_x double, origin_y double, pixel_x double, pixel_y double, problem string"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def tags(data: bytes) -> dict[int, tuple]:
    """Tags of the first image of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _CODES:
            continue
        size = _SIZES[kind] * n
        begin = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        raw = data[begin : begin + size]
        out[tag] = (raw,) if kind == 2 else struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
    return out


def header(data: bytes) -> tuple:
    """Width, height, bands, bits, EPSG code, origin and pixel size; the problem, if there is one."""
    try:
        t = tags(data)
        width, height = t[256][0], t[257][0]
    except (ValueError, KeyError, struct.error, IndexError) as e:
        return (None,) * 9 + (f"unreadable: {e}",)
    keys = t.get(34735, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    tie, scale = t.get(33922), t.get(33550)
    origin = (tie[3], tie[4]) if tie and len(tie) >= 6 else (None, None)
    pixel = (scale[0], scale[1]) if scale and len(scale) >= 2 else (None, None)
    problem = "no coordinate system" if epsg is None else "no transform" if None in (*origin, *pixel) else None
    return width, height, t.get(277, (1,))[0], t.get(258, (None,))[0], epsg, *origin, *pixel, problem


def inspected(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every TIFF in a folder: what its header says, and why it is refused if it is."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, hashlib.sha256(d).hexdigest(), *header(d)) for p, d in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(folder).select("path", "content").mapInPandas(run, HEADER)


def zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Text columns of the first member of an archive whose name ends so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(BytesIO(data)) as z:
                    name = next((n for n in z.namelist() if n.endswith(member)), None)
                    if name is not None:
                        for part in pd.read_csv(BytesIO(z.read(name)), dtype=str, keep_default_na=False, chunksize=10_000):
                            yield part.reindex(columns=columns).replace({"": None})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


ITEM = "features array<struct<id:string,bbox:array<double>,properties:struct<datetime:string,`eo:cloud_cover`:double,`proj:epsg`:int,`s2:processing_baseline`:string>,assets:map<string,struct<href:string>>>>"
ASSETS = ["blue", "green", "red", "nir", "swir16", "scl"]


def catalogue(spark: SparkSession, path: str, most_cloud: float = 100.0) -> DataFrame:
    """Saved catalogue pages as items with the reason for which one is set aside."""
    items = spark.read.schema(ITEM).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    p = F.col("properties")
    cloud, epsg, baseline = p["eo:cloud_cover"], p["proj:epsg"], p["s2:processing_baseline"]
    reason = F.coalesce(
        F.when(F.try_to_timestamp(p["datetime"]).isNull(), "no time"),
        F.when(epsg.isNull(), "no coordinate system"),
        F.when(baseline.isNull(), "no baseline"),
        F.when(~F.forall(F.array(*map(F.lit, ASSETS)), lambda a: F.map_contains_key("assets", a)), "assets missing"),
    )
    return items.where(F.coalesce(cloud, F.lit(0.0)) <= most_cloud).select("id", "bbox", p["datetime"].alias("acquired_at"), cloud.alias("cloud"), epsg.alias("epsg"), baseline.alias("baseline"), reason.alias("reason"))


def covers(bbox: Column, west: float, south: float, east: float, north: float) -> Column:
    """All corners of an area are inside a footprint's box."""
    return (bbox[0] <= west) & (bbox[1] <= south) & (bbox[2] >= east) & (bbox[3] >= north)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, stamp and path of the files named ``source/stamp.ext`` under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("source_id"), F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1)).alias("stamp"), "path")


def latest_snapshot(found: DataFrame) -> DataFrame:
    return found.groupBy("source_id").agg(F.max("stamp").alias("stamp"), F.max_by("path", "stamp").alias("path"))


def superfluous(found: DataFrame, keep: int) -> DataFrame:
    """Snapshots beyond the newest of each source."""
    return found.join(retained(found, keep).select("path"), "path", "left_anti")


def output_problems() -> Column:
    """Problems of a model's output record under the contract."""
    confidence = F.col("confidence").isNull() | F.col("confidence").between(0, 1)
    return contract_problems([(F.col("capability").isNotNull(), "capability missing"), (F.col("model").isNotNull(), "model missing"), (F.col("kind").isin("detection", "segmentation", "classification", "similarity", "summary"), "unknown kind"), (confidence, "confidence out of range"), (F.size("evidence") > 0, "no evidence")])


def pixels(data: bytes) -> np.ndarray:
    """Pixels (rows, columns, bands) of a striped TIFF, plain or deflated, chunky."""
    t = tags(data)
    order = "<" if data[:2] == b"II" else ">"
    width, height, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    bits, kind = t.get(258, (8,))[0], {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
    packing = t.get(259, (1,))[0]
    if packing not in (1, 8, 32946) or 273 not in t or t.get(284, (1,))[0] != 1 or t.get(317, (1,))[0] != 1:
        raise ValueError("only plain or deflated strips of interleaved bands are read")
    strips = [data[a : a + n] for a, n in zip(t[273], t[279], strict=True)]
    raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
    return np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}"), height * width * bands).reshape(height, width, bands)


def raster_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, band, row and values of every line of every raster under a path; a file that cannot be read gives its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "band", "row", "values", "problem"]
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    a = pixels(data)
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    yield pd.DataFrame([(p, None, None, None, str(e))], columns=names)
                    continue
                for b in range(a.shape[2]):
                    yield pd.DataFrame([(p, b, r, a[r, :, b].astype(float).tolist(), None) for r in range(a.shape[0])], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, band int, row int, values array<double>, problem string")


def uses(headers: DataFrame, bands: int = 6) -> DataFrame:
    """headers with, for each use, whether a file serves it: supported, or what stands against it."""

    def verdict(*checks: tuple[Column, str]) -> Column:
        against = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in checks]), lambda m: m.isNotNull())
        return F.when(F.size(against) == 0, "SUPPORTED").otherwise(F.concat(F.lit("NOT COMPATIBLE: "), F.array_join(against, "; ")))

    placed = (F.col("problem").isNull(), "no place on the ground")
    return headers.withColumns({"display": verdict(placed), "change": verdict(placed, (F.col("bands") >= bands, "bands missing"), (F.col("bits") == 16, "not 16 bits")), "search": verdict(placed, (F.col("bands") >= 3, "no colour bands"))})


def unregistered(headers: DataFrame, registered: DataFrame) -> DataFrame:
    """Files whose content is not registered yet; of equal ones, one."""
    return headers.dropDuplicates(["sha256"]).join(registered.select("sha256"), "sha256", "left_anti")
