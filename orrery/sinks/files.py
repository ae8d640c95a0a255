"""GeoJSON, GeoPackage, PNG and report files."""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geo


def features(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON Feature a row, as text; rows without a place have a null geometry."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    props = F.struct(*[c for c in rows.columns if c not in (lon, lat)])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_features(rows: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, written in parallel."""
    features(rows).write.mode("overwrite").text(path)


def collection(rows: DataFrame, most: int = 10_000) -> str:
    """A FeatureCollection for one response: at most so many features, streamed from the executors."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r.value for r in features(rows.limit(most)).toLocalIterator()) + "]}"


def geopackage(path: str, layers: dict[str, Iterable[dict]]) -> None:
    """A GeoPackage of point layers: dicts with lon and lat, other values as text. For exports of a review's size."""
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.executescript(
            """
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84"]', NULL), ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL);
            """
        )
        for name, rows in layers.items():
            if not name.isidentifier():
                raise ValueError(f"bad layer name {name!r}")
            box: list[float] | None = None
            made = False
            for row in rows:
                names = [k for k in row if k not in ("lon", "lat")]
                if not made:
                    quoted = ", ".join('"' + n.replace('"', '""') + '" TEXT' for n in names)
                    db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{", " + quoted if quoted else ""})')
                    made = True
                x, y = row.get("lon"), row.get("lat")
                blob = None if x is None or y is None else geo.geopackage_blob(geo.wkb_point(x, y))
                if blob is not None:
                    box = [x, y, x, y] if box is None else [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
                db.execute(f'INSERT INTO "{name}" VALUES (NULL, ?{", ?" * len(names)})', [blob, *[None if row[n] is None else str(row[n]) for n in names]])
            if not made:
                db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB)')
            db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), ?, ?, ?, ?, 4326)", [name, name, *(box or [None] * 4)])
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', 4326, 0, 0)", [name])


def png(pixels: np.ndarray) -> bytes:
    """An RGB picture of bytes (rows, columns, 3)."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def report(metrics: dict) -> tuple[str, str]:
    """The same measures as canonical JSON and as Markdown; what was not measured says so."""
    text = json.dumps(metrics, sort_keys=True, indent=1, ensure_ascii=False)
    return text, "\n".join(["| measure | value |", "|-|-|", *[f"| {k} | {'NOT AVAILABLE' if v is None else v} |" for k, v in sorted(metrics.items())]])
