"""Shapefiles of any size, read in ranges of records: polygons of multi-gigabyte SHP files and rows of DBF files.

A file is split by bytes: the record index (SHX) is searched for the records at even places, without reading it whole; a file
without index has its record headers walked once. Each task reads its own ranges through pyarrow's file systems, so paths are
local or mounted ones and the URIs that those know. A record's points are never read whole: rings are measured slice by slice,
holes go to their shells by winding numbers, and a record gives one row a polygon part.

Null shapes and records without a usable ring give no parts; an unclosed ring, a hole that can't be placed, or bytes that aren't
what the format says raise an error that names the file and the record.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import shoelace
from ..functions.rings import AmbiguousHole, CorruptShape, assigned, measured, polygon_ewkb
from .shapefiles import dbf_fields, dbf_value

#: Polygon, PolygonZ and PolygonM; the points stand in the same place in all.
POLYGONS = (5, 15, 25)
BATCH_BYTES = 16 << 20
PARTS = "file string, rec long, part int, n_points long, n_holes int, area double, geom binary"
RECORDS = "file string, rec long, shape_type int, n_rings long, n_points long, n_shells long, n_holes long, n_degenerate long, n_unclosed long, area double"
ROWS = "file string, rec long, values map<string,string>"


def opened(path: str) -> pa.NativeFile:
    files, name = pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)
    return files.open_input_file(name)


def listed(path: str, ending: str) -> list[str]:
    """The file itself, or the files of a folder with this ending."""
    if path.lower().endswith(ending):
        return [path]
    uri = "://" in path or path.startswith("file:")
    files, name = pf.FileSystem.from_uri(path) if uri else (pf.LocalFileSystem(), path)
    found = sorted(x.path for x in files.get_file_info(pf.FileSelector(name)) if x.path.lower().endswith(ending))
    head = path[: len(path) - len(name)] if uri else ""
    return [head + x for x in found]


class Range(InputPartition):
    """Bytes of a file from a record on."""

    def __init__(self, file: str, start: int, end: int, rec: int):
        super().__init__((file, start, end, rec))
        self.file, self.start, self.end, self.rec = file, start, end, rec


def shape_ranges(file: str, splits: int) -> list[Range]:
    """Ranges of about equal bytes that begin at records."""
    with opened(file) as f:
        size = f.size()
        head = f.read_at(100, 0)
        if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
            raise CorruptShape(f"{file}: no shapefile header")
        targets = [100 + (size - 100) * k // splits for k in range(1, splits)]
        try:
            with opened(file[:-1] + ("X" if file[-1] == "P" else "x")) as index:
                n = (index.size() - 100) // 8
                offset = lambda k: 2 * struct.unpack(">i", index.read_at(4, 100 + 8 * k))[0] if k < n else size
                starts = [(offset(0), 1)] if n else []
                for t in targets:
                    low, high = 0, n
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (mid + 1, high) if offset(mid) < t else (low, mid)
                    starts.append((offset(low), low + 1))
        except FileNotFoundError:
            starts, at, rec = [], 100, 1
            while at + 8 <= size:
                if not starts or (targets and at >= targets[0]):
                    starts.append((at, rec))
                    targets = [t for t in targets if t > at]
                at += 8 + 2 * struct.unpack(">i", f.read_at(4, at + 4))[0]
                rec += 1
    starts = sorted({s for s in starts if s[0] < size})
    return [Range(file, a, b, rec) for (a, rec), b in zip(starts, [s for s, _ in starts[1:]] + [size])]


def records(f: pa.NativeFile, part: Range):
    """(record number, shape type, content's place, its bytes) of a range."""
    at, rec = part.start, part.rec
    while at + 8 <= part.end:
        number, words = struct.unpack(">2i", f.read_at(8, at))
        if words < 2 or at + 8 + 2 * words > part.end:
            raise CorruptShape(f"{part.file}: record {rec} is longer than its file")
        yield rec, struct.unpack("<i", f.read_at(4, at + 8))[0], at + 8, 2 * words
        at += 8 + 2 * words
        rec += 1


def rings_at(f: pa.NativeFile, at: int, size: int, shape: int):
    """The reader of a record's points, and the measures of its rings."""
    if shape not in POLYGONS:
        raise CorruptShape(f"shape type {shape} is no polygon")
    n, points = struct.unpack("<2i", f.read_at(8, at + 36)) if size >= 44 else (-1, -1)
    if n < 0 or points < 0 or 44 + 4 * n + 16 * points > size:
        raise CorruptShape("counts don't fit the record")
    starts = np.frombuffer(f.read_at(4 * n, at + 44), "<i4").astype(np.int64)
    begin = at + 44 + 4 * n
    read = lambda k, many: np.frombuffer(f.read_at(16 * many, begin + 16 * k), "<f8").reshape(-1, 2)
    return read, measured(read, starts, points)


def polygon_parts(f: pa.NativeFile, at: int, size: int, shape: int, srid: int | None):
    """(points, holes, area, EWKB) of each part of a record, shells in the record's order."""
    read, rings = rings_at(f, at, size, shape)
    if not rings.usable().any():
        return
    if not rings.closed[rings.sizes >= 4].all():
        raise CorruptShape("a ring isn't closed")
    home = assigned(read, rings)
    holes = rings.holes()
    by_shell = holes[np.argsort(home[holes], kind="stable")]
    for s in rings.shells().tolist():
        own = by_shell[np.searchsorted(home[by_shell], s, "left") : np.searchsorted(home[by_shell], s, "right")].tolist()
        yield int(rings.sizes[[s, *own]].sum()), len(own), float(-rings.areas[s] - rings.areas[own].sum()), polygon_ewkb(read, rings, [s, *own], srid)


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = pa.schema([_field(x) for x in schema.split(", ")]), options

    def read(self, part):
        """Record batches of about BATCH_BYTES of geometry; a source without a range is read once, with none."""
        held, size = [], 0
        for row in self.rows(part) if part else ():
            held.append(row)
            size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
            if size >= BATCH_BYTES or len(held) >= 8192:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), self.schema)], schema=self.schema)

    def partitions(self):
        splits = int(self.options.get("splits", "32"))
        return [p for file in listed(self.options["path"], ".shp") for p in shape_ranges(file, splits)]


def _field(text: str) -> pa.Field:
    name, kind = text.split(" ", 1)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.field(name, kinds[kind])


class _Parts(_Reader):
    def rows(self, part):
        srid = int(self.options.get("srid", "0")) or None
        with opened(part.file) as f:
            for rec, shape, at, size in records(f, part):
                if not shape:
                    continue
                try:
                    for k, found in enumerate(polygon_parts(f, at, size, shape, srid)):
                        yield (part.file, rec, k, *found)
                except (CorruptShape, AmbiguousHole) as error:
                    raise type(error)(f"{part.file}, record {rec}: {error}") from None


class _Records(_Reader):
    def rows(self, part):
        with opened(part.file) as f:
            for rec, shape, at, size in records(f, part):
                if not shape:
                    yield (part.file, rec, 0, 0, 0, 0, 0, 0, 0, 0.0)
                    continue
                try:
                    _, r = rings_at(f, at, size, shape)
                except CorruptShape as error:
                    raise CorruptShape(f"{part.file}, record {rec}: {error}") from None
                usable = r.usable()
                yield (part.file, rec, shape, len(r.areas), int(r.sizes.sum()), len(r.shells()), len(r.holes()), int((~usable).sum()), int((~r.closed[r.sizes >= 4]).sum()), r.net_area())


class _Rows(_Reader):
    """Rows of DBF files: records have one length, so ranges are plain arithmetic."""

    def partitions(self):
        out, splits = [], int(self.options.get("splits", "32"))
        for file in listed(self.options["path"], ".dbf"):
            with opened(file) as f:
                count, head, size = struct.unpack("<IHH", f.read_at(12, 0)[4:12])
                count = min(count, max(0, f.size() - head) // size) if size else 0
            cuts = [count * k // splits for k in range(splits + 1)]
            out += [Range(file, head + a * size, head + b * size, a + 1) for a, b in zip(cuts, cuts[1:]) if a < b]
        return out

    def rows(self, part):
        encoding = self.options.get("encoding", "cp1252")
        with opened(part.file) as f:
            _, head, size = struct.unpack("<IHH", f.read_at(12, 0)[4:12])
            fields = dbf_fields(f.read_at(head, 0))
            step = max(1, (1 << 20) // size)
            for at in range(part.start, part.end, step * size):
                raw = f.read_at(min(step * size, part.end - at), at)
                for k in range(0, len(raw), size):
                    if raw[k : k + 1] == b"*":
                        continue
                    values, place = {}, k + 1
                    for name, kind, width, _ in fields:
                        v = dbf_value(kind, raw[place : place + width], encoding)
                        values[name] = None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
                        place += width
                    yield (part.file, part.rec + (at - part.start + k) // size, list(values.items()))


class ShapeParts(DataSource):
    """Parts of polygon records: file, rec (from 1), part, points, holes, area and EWKB. Options: path (a file or folder), splits a
    file, srid."""

    kind, columns = _Parts, PARTS

    @classmethod
    def name(cls) -> str:
        return "shape_parts"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.kind(self.columns, dict(self.options))


class ShapeRecords(ShapeParts):
    """Counts and net area of each polygon record, null shapes included."""

    kind, columns = _Records, RECORDS

    @classmethod
    def name(cls) -> str:
        return "shape_records"


class ShapeRows(ShapeParts):
    """Live rows of DBF files, values as text. Options: path, splits, encoding."""

    kind, columns = _Rows, ROWS

    @classmethod
    def name(cls) -> str:
        return "shape_rows"


def read_ranges(spark: SparkSession, kind: type[ShapeParts], path: str, **options) -> DataFrame:
    """A source of this module over a path, e.g. ``read_ranges(spark, ShapeParts, "s3://bucket/layer.shp", splits=500)``."""
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def record_parts(df: DataFrame, content: str) -> DataFrame:
    """The parts of polygon records that stand in a binary column, instead of a file: the other columns, then part, n_points,
    n_holes, area and geom."""
    ids = [c for c in df.columns if c != content]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)

    def parse(batches):
        for batch in batches:
            places, found = [], []
            for k, raw in enumerate(batch.column(len(ids)).to_pylist()):
                if raw is None or (shape := struct.unpack_from("<i", raw)[0]) == 0:
                    continue
                parts = list(polygon_parts(pa.BufferReader(raw), 0, len(raw), shape, None))
                places += [k] * len(parts)
                found += [(n, *p) for n, p in enumerate(parts)]
            own = batch.take(pa.array(places, pa.int64()))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            columns = [pa.array([f[c] for f in found], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*own.columns[: len(ids)], *columns], [*ids, "part", "n_points", "n_holes", "area", "geom"])

    return df.select(*ids, content).mapInArrow(parse, f"{kinds}, part int, n_points long, n_holes int, area double, geom binary")


def record_bytes(geom: dict) -> bytes:
    """A polygon as the content of a shape record: shells clockwise, holes counter-clockwise, all rings closed."""
    rings = []
    for part in geom["parts"]:
        for place, ring in enumerate(part):
            p = np.asarray(ring if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]], "<f8")
            rings.append(p if (shoelace(p.tolist()) > 0) == (place > 0) else p[::-1])
    points = np.concatenate(rings)
    starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
    return struct.pack("<i4d2i", 5, *points.min(0), *points.max(0), len(rings), len(points)) + starts.tobytes() + np.ascontiguousarray(points).tobytes()
