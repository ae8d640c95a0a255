"""Zipped shapefiles as a Python data source: one input partition for each archive."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ordinal int, properties string, geometry string"


def _dbf(data: bytes) -> list[dict]:
    count, header, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for i in range(count):
        row, at = data[header + i * size : header + (i + 1) * size], 1
        item = {}
        for name, kind, width in fields:
            text = row[at : at + width].decode("utf-8", "replace").strip(" \0")
            at += width
            if not text:
                item[name] = None
            elif kind in "NF":
                item[name] = float(text) if "." in text or "e" in text.lower() else int(text)
            else:
                item[name] = text
        out.append(item)
    return out


def _signed(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _geometry(body: bytes) -> dict | None:
    kind = struct.unpack("<i", body[:4])[0] % 10
    if kind == 0:
        return None
    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack("<dd", body[4:20]))}
    if kind == 8:
        n = struct.unpack("<i", body[36:40])[0]
        return {"type": "MultiPoint", "coordinates": [list(struct.unpack("<dd", body[40 + 16 * i : 56 + 16 * i])) for i in range(n)]}
    parts, points = struct.unpack("<ii", body[36:44])
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
    flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    lines = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        return {"type": "LineString", "coordinates": lines[0]} if parts == 1 else {"type": "MultiLineString", "coordinates": lines}
    polygons: list[list] = []
    for ring in lines:  # clockwise rings begin a polygon, others are holes in it
        if _signed(ring) <= 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}


def records(archive: bytes) -> Iterator[tuple[int, str, str]]:
    """Ordinal, properties and GeoJSON geometry of every record that has a shape."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        named = {n.rsplit(".", 1)[-1].lower(): n for n in z.namelist()}
        shapes, rows = z.read(named["shp"]), _dbf(z.read(named["dbf"]))
    at, i = 100, 0
    while at < len(shapes):
        length = struct.unpack(">i", shapes[at + 4 : at + 8])[0] * 2
        g = _geometry(shapes[at + 8 : at + 8 + length])
        if g is not None and i < len(rows):
            yield i, json.dumps({k.lower(): v for k, v in rows[i].items()}), json.dumps(g)
        at, i = at + 8 + length, i + 1


class _Archive(InputPartition):
    def __init__(self, data: bytes):
        self.data = data


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        with open(self.options["path"], "rb") as f:
            return [_Archive(f.read())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from records(partition.data)


class ShapefileSource(DataSource):
    """``spark.read.format("zipped-shapefile").load(path)``, for archives on the driver's disk; ``read`` takes any path."""

    @classmethod
    def name(cls) -> str:
        return "zipped-shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str):
    """Archives under a path that Spark can open, one task for each file."""
    from collections.abc import Iterator as It

    import pandas as pd

    def run(batches: It[pd.DataFrame]) -> It[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(list(records(data)), columns=["ordinal", "properties", "geometry"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
