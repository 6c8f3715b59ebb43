"""Shapefiles: attribute tables (DBF), shapes (SHP) and zipped packages, one package a task."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.geometry import assemble


def dbf_fields(head: bytes) -> list[tuple[str, str, int, int]]:
    """(name, kind, width, decimals) of a table's fields, from its header."""
    fields, at = [], 32
    while at + 32 <= len(head) and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return fields


def dbf_value(kind: str, text: bytes, encoding: str):
    """A field's value: blanks are null, dates ISO, logicals boolean."""
    text = text.decode(encoding, "replace").strip(" \0")
    if not text:
        return None
    if kind in "NFO":
        try:
            number = float(text)
            return None if number != number else number
        except ValueError:
            return None
    if kind == "L":
        return text[0] in "yYtT1"
    if kind == "D" and len(text) == 8:
        return f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return text


def read_dbf(raw: bytes, encoding: str = "cp1252"):
    """(fields, rows): rows are value lists, None for a deleted one."""
    count, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, rows = dbf_fields(raw[:head]), []
    for k in range(count):
        start = head + k * size
        if raw[start : start + 1] == b"*":
            rows.append(None)
            continue
        at, row = start + 1, []
        for _, kind, width, _ in fields:
            row.append(dbf_value(kind, raw[at : at + width], encoding))
            at += width
        rows.append(row)
    return fields, rows


def read_shp(raw: bytes) -> list[dict | None]:
    """Geometries of all records as GeoJSON objects; null shapes are None; further dimensions are dropped."""
    out, at = [], 100
    while at + 8 <= len(raw):
        (words,) = struct.unpack_from(">I", raw, at + 4)
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body)
        base = kind % 10
        if kind == 0:
            out.append(None)
        elif base == 1:
            out.append({"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))})
        elif base == 8:
            (n,) = struct.unpack_from("<i", body, 36)
            out.append({"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<2d", body, 40 + 16 * i)) for i in range(n)]})
        elif base in (3, 5):
            parts, points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = [struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * i) for i in range(points)]
            rings = [xy[a:b] for a, b in zip(starts, starts[1:])]
            if base == 3:
                lines = [[list(p) for p in r] for r in rings]
                out.append({"type": "LineString", "coordinates": lines[0]} if len(lines) == 1 else {"type": "MultiLineString", "coordinates": lines})
            else:
                shapes = [[[list(p) for p in r] for r in poly] for poly in assemble(rings)]
                out.append({"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes})
        else:
            raise ValueError(f"shape type {kind}")
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, values, geometry): live records of zipped shapefiles, values as text, geometry as GeoJSON text."""

    def parse(frames):
        for frame in frames:
            for file, raw in zip(frame.path, frame.content):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    member = {n.rsplit(".", 1)[-1].lower(): n for n in z.namelist()}
                    encoding = z.read(member["cpg"]).decode().strip() if "cpg" in member else "cp1252"
                    fields, rows = read_dbf(z.read(member["dbf"]), encoding)
                    shapes = read_shp(z.read(member["shp"]))
                text = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
                out = [
                    (file, k, {f[0]: text(v) for f, v in zip(fields, row)}, json.dumps(g) if g else None)
                    for k, (row, g) in enumerate(zip(rows, shapes), 1) if row is not None
                ]
                yield pd.DataFrame(out, columns=["file", "rec", "values", "geometry"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, rec long, values map<string,string>, geometry string")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, values, geometry) of feature collections, the same shape as shapefiles."""

    def parse(frames):
        for frame in frames:
            for file, raw in zip(frame.path, frame.content):
                features = json.loads(raw.decode("utf-8-sig"))["features"]
                text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
                out = [(file, k, {n: text(v) for n, v in (f.get("properties") or {}).items()}, json.dumps(f["geometry"]) if f.get("geometry") else None) for k, f in enumerate(features, 1)]
                yield pd.DataFrame(out, columns=["file", "rec", "values", "geometry"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, rec long, values map<string,string>, geometry string")
