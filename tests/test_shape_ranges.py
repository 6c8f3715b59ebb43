"""Shapefiles in ranges: splits, holes, errors, on files written here."""

import random
import struct
import time

import numpy as np
import pytest

from tessella.functions import geometry as G, rings as R
from tessella.sources.shape_ranges import ShapeParts, ShapeRecords, ShapeRows, read_ranges


def square(x, y, s, shell=True):
    """A closed ring, clockwise for shells."""
    ring = [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    return ring if shell else ring[::-1]


def shape(rings, kind=5):
    points = np.array([p for r in rings for p in r], "<f8").reshape(-1, 2)
    starts = np.cumsum([0, *map(len, rings)])[:-1].astype("<i4")
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(points)) + starts.tobytes() + points.tobytes()


def write(folder, bodies, index=True, name="layer"):
    shp, shx, at = b"", b"", 100
    for k, body in enumerate(bodies, 1):
        shx += struct.pack(">2i", at // 2, len(body) // 2)
        shp += struct.pack(">2i", k, len(body) // 2) + body
        at += 8 + len(body)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i", 1000, 5) + bytes(64)
    (folder / f"{name}.shp").write_bytes(head(100 + len(shp)) + shp)
    if index:
        (folder / f"{name}.shx").write_bytes(head(100 + len(shx)) + shx)
    return str(folder / f"{name}.shp")


def layer(rng):
    """Records with parts, holes at random sizes, null shapes, degenerate rings, one with further dimensions."""
    out = [struct.pack("<i", 0), shape([square(0, 0, 9), square(1, 1, 2, False), square(20, 0, 5), square(4, 4, 3, False)]), shape([[(0, 0), (1, 1), (0, 0)]]), shape([square(0, 0, 4), [(9, 9)] * 5])]
    out.append(shape([square(0, 0, 9), square(1, 1, 2, False)], 15) + struct.pack("<2d", 0, 1) + bytes(80))
    for _ in range(60):
        rings = []
        for k in range(rng.randrange(1, 6)):
            size = rng.randrange(4, 30)
            rings.append(square(40 * k, 0, size))
            rings += [square(40 * k + 1 + 3 * h, 1, 1, False) for h in range(rng.randrange(size // 3))]
        rng.shuffle(rings)
        out.append(shape(rings))
    return out


@pytest.mark.parametrize("index", [True, False])
def test_splits_give_the_same_rows(spark, tmp_path, index):
    path = write(tmp_path, layer(random.Random(1)), index)
    of = lambda kind, n: sorted(tuple(r) for r in read_ranges(spark, kind, path, splits=n, srid=32721).collect())
    one, many = of(ShapeParts, 1), of(ShapeParts, 13)
    assert one == many and read_ranges(spark, ShapeParts, path, splits=13).rdd.getNumPartitions() > 8
    assert of(ShapeRecords, 1) == of(ShapeRecords, 7) and len(of(ShapeRecords, 7)) == 65
    parts = {(r[1], r[2]): r for r in one}
    assert [parts[2, k][3:6] for k in (0, 1)] == [(15, 2, 81.0 - 4 - 9), (5, 0, 25.0)] and (1, 0) not in parts and (3, 0) not in parts
    assert parts[5, 0][5] == 77.0
    g = G.parse_ewkb(bytes(parts[2, 0][6]).hex())
    assert G.area(g) == 68.0 and len(g["parts"][0]) == 3
    records = {r[1]: r[2:] for r in of(ShapeRecords, 3)}
    assert records[1] == (0,) * 7 + (0.0,) and records[4][3:7] == (1, 0, 1, 0) and records[2][-1] == 93.0
    for rec in range(6, 66):
        assert sum(r[5] for r in one if r[1] == rec) == pytest.approx(records[rec][-1]) and sum(r[4] for r in one if r[1] == rec) == records[rec][4]
    assert len(read_ranges(spark, ShapeParts, str(tmp_path), splits=2).collect()) == len(one)


@pytest.mark.parametrize("rings, error", [
    ([square(0, 0, 4), square(9, 9, 2, False)], "lie in no shell"),
    ([square(0, 0, 4), square(0, 0, 4, False)], "can't be told from a border"),
    ([square(0, 0, 4)[:-1] + [(1, 1)]], "isn't closed"),
])
def test_bad_records_are_named(spark, tmp_path, rings, error):
    if "border" in error:
        rings = [square(-1, -1, 9), *rings]
    path = write(tmp_path, [shape([square(0, 0, 1)]), shape(rings)])
    with pytest.raises(Exception, match=f"record 2: .*{error}"):
        read_ranges(spark, ShapeParts, path).collect()
    assert read_ranges(spark, ShapeRecords, path).count() == 2


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.shp").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no shapefile header"):
        read_ranges(spark, ShapeParts, str(tmp_path / "x.shp")).collect()
    path = write(tmp_path, [struct.pack("<i2d", 1, 0.0, 0.0)])
    with pytest.raises(Exception, match="is no polygon"):
        read_ranges(spark, ShapeParts, path).collect()
    path = write(tmp_path, [])
    assert read_ranges(spark, ShapeParts, path).count() == 0


def big():
    """A shell of 200,000 vertices with 1,000 holes."""
    t = np.linspace(0, -2 * np.pi, 200_001)
    shell = np.stack([np.cos(t), np.sin(t)], 1) * (1000 + 5 * np.sin(900 * t))[:, None]
    shell[-1] = shell[0]
    holes = [np.array(square(-600 + 38 * (k % 32), -600 + 38 * (k // 32), 9, False), float) for k in range(1000)]
    rings = [*holes[:500], shell, *holes[500:]]
    return np.concatenate(rings), np.cumsum([0, *map(len, rings)])[:-1]


def test_many_holes_of_a_large_shell(monkeypatch):
    points, starts = big()
    read = lambda k, n: points[k : k + n]
    begin = time.time()
    whole = R.measured(read, starts, len(points))
    home = R.assigned(read, whole)
    assert time.time() - begin < 2
    assert (np.delete(home, 500) == 500).all() and home[500] == -1
    assert whole.net_area() == pytest.approx(-whole.areas[500] - 81_000)
    monkeypatch.setattr(R, "SLICE", 777)
    parts = R.measured(read, starts, len(points))
    assert np.allclose(parts.areas, whole.areas, rtol=1e-13, atol=0) and (parts.low == whole.low).all() and (parts.probes == whole.probes).all() and parts.closed.all()
    assert (R.assigned(read, parts) == home).all()


def test_far_off_coordinates_keep_their_area():
    ring = np.array(square(600_000.125, 6_100_000.25, 0.5)) + 0.0
    found = R.measured(lambda k, n: ring[k : k + n], np.array([0]), 5)
    assert found.areas[0] == -0.25


def test_holes_go_to_the_smallest_shell_and_try_other_edges():
    """Islands in holes; a hole whose first edge lies on the border of its shell is told by the next one."""
    rings = [square(0, 0, 90), square(10, 10, 60, False), square(20, 20, 30), square(22, 22, 5, False)]
    touching = [(0.0, 80.0), (0.0, 82.0), (2.0, 82.0), (0.0, 80.0)][::-1]
    touching = touching[2:3] + touching[:0] + [touching[1], touching[0], touching[2]]
    for extra in ([], [touching]):
        everything = rings + extra
        points = np.array([p for r in everything for p in r], float)
        starts = np.cumsum([0, *map(len, everything)])[:-1]
        read = lambda k, n: points[k : k + n]  # noqa: B023, E731
        m = R.measured(read, starts, len(points))
        home = R.assigned(read, m)
        assert home[:4].tolist() == [-1, 0, -1, 2]


def test_rows_of_attribute_tables(spark, tmp_path):
    fields = [(b"ID", b"N", 6), (b"NAME", b"C", 8), (b"DAY", b"D", 8)]
    size = 1 + sum(w for _, _, w in fields)
    head = struct.pack("<B3sIHH20x", 3, b"\0\0\0", 50, 32 + 32 * len(fields) + 1, size)
    head += b"".join(n.ljust(11, b"\0") + k + bytes(4) + bytes([w, 0]) + bytes(14) for n, k, w in fields) + b"\r"
    rows = b"".join((b"*" if k % 7 == 3 else b" ") + str(k).rjust(6).encode() + (f"ñ{k}".encode("cp1252") if k % 2 else b"").ljust(8) + b"20240229" for k in range(1, 51))
    (tmp_path / "t.dbf").write_bytes(head + rows)
    got = sorted((r.rec, r["values"]) for r in read_ranges(spark, ShapeRows, str(tmp_path / "t.dbf"), splits=6).collect())
    assert got == [(k, {"ID": str(k), "NAME": f"ñ{k}" if k % 2 else None, "DAY": "2024-02-29"}) for k in range(1, 51) if k % 7 != 3]
