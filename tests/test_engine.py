"""Value rules, sources, geometry kernels, pairing and streaming on small inputs."""

import io
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import columns, geometry as G, values as V
from tessella.operators import joins, reconcile
from tessella.sources import shapefiles, text_files


def one(spark, schema, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_clean_values(spark):
    cases = [(None, ""), ("  a ", "a"), ('"a"', "a"), ("' b '", "b"), ("12.0", "12"), ("1\t2\n", "12"), (" x﻿", "x"), ("1.00", "1.00"), ('""', "")]
    assert one(spark, "v string", [(c,) for c, _ in cases], V.clean_value(F.col("v"))) == [(w,) for _, w in cases]


def test_repair_and_equivalence(spark):
    broken = "Peñarol áé".encode().decode("latin-1")
    rows = [("Peñarol áé", broken, True), ("Pe�arol", "Peñarol", True), ("Pe�arol", "Pexx1rol", False), ("(Pe�.)", "(Peña.)", True), ("(Pe�.)", "(Peñax)", False), ("a", "A", False), (None, " ", True), ("5.0", "5", True), ("Ãx", "Ãx", True)]
    assert [r[0] for r in one(spark, "a string, b string, w boolean", rows, V.equivalent(F.col("a"), F.col("b")))] == [r[2] for r in rows]
    texts = [("Ã", "Ã"), (broken, "Peñarol áé"), ("â‚¬ Â", "â‚¬ Â"), ("Ã±â‚¬", "ñ€"), ("Ã±日", "Ã±日"), (None, None), ("plain", "plain")]
    assert one(spark, "t string", [(t,) for t, _ in texts], V.repair_encoding(F.col("t"))) == [(w,) for _, w in texts]


def test_keys(spark):
    rows = [(" A ", "1.0"), (None, "x"), (None, ""), ("N/A", "s/n")]
    got = one(spark, "a string, b string", rows, V.composite_key([F.col("a"), F.col("b")]), V.composite_key([F.col("a"), F.col("b")], True))
    assert got == [("a|1", "a|1"), ("|x", "|x"), (None, None), ("n/a|s/n", None)]
    assert one(spark, "u string", [("a:id:12",), ("none",), (None,)], V.urn_tail(F.col("u"))) == [(12,), (None,), (None,)]


def test_edit_distance_and_mapping():
    assert [V.edit_distance(a, b) for a, b in (("", "ab"), ("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"))] == [2, 1, 3, 3]
    got = columns.auto_map(["ID", "nombre", "departamen", "localidd", "x"], ["id", "Nombré", "departamento", "localidad", "y"])
    assert got == {"id": "ID", "Nombré": "nombre", "departamento": "departamen", "localidad": "localidd"}
    assert columns.insert_plan([{"name": "a", "nullable": False, "has_default": False}, {"name": "b", "nullable": True, "has_default": False}], {}, {"b": "1"}) == (["b"], ["a"])


def test_not_in_follows_sql_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    of = lambda rows: sorted((r.k for r in joins.not_in(left, spark.createDataFrame(rows, "r long"), "k", "r").collect()), key=str)
    assert of([(1,)]) == [2] and of([(1,), (None,)]) == [] and of([]) == [1, 2, None]


def test_records_and_delimiters():
    assert list(text_files.records('a,"b ""c""\nd",e\r\nf,,\n', ",")) == [(1, ["a", 'b "c"\nd', "e"]), (3, ["f", "", ""])]
    assert [f for _, f in text_files.records('a;"open\nb;c', ";", multiline=False)] == [["a", "open"], ["b", "c"]]
    with pytest.raises(ValueError):
        list(text_files.records('a,"open\n', ","))
    assert text_files.detect_delimiter('a;b;"c,d,e"') == ";" and text_files.decode(b"\xf1") == "ñ"
    assert text_files.spatial_columns(["id", "WKT", "Latitud", "lng"]) == {"geometry": "WKT", "lat": "Latitud", "lng": "lng"}
    assert text_files.point_text("-34,5", "-56.1") == "POINT(-56.1 -34.5)" and text_files.point_text("", "") is None
    pattern = r"_(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)\.csv$"
    assert text_files.file_date("x_20240229.csv", pattern).day == 29 and text_files.file_date("x_20230229.csv", pattern) is None


def test_read_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name\n1;ñandú\n2\n3;x\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"id,id\n1,2\n")
    rows = sorted(text_files.read_delimited(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.rec))
    assert [(r.rec, r["values"], bool(r.error)) for r in rows] == [(1, {"id": "1", "name": "ñandú"}, False), (2, None, True), (3, {"id": "3", "name": "x"}, False), (0, None, True)]


def test_shapefile(spark, tmp_path):
    fields = [("ID", "N", 4), ("NAME", "C", 5), ("DAY", "D", 8), ("OK", "L", 1)]
    head = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 3, 32 + 32 * len(fields) + 1, 1 + sum(w for *_, w in fields))
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, 0) for n, k, w in fields) + b"\r"
    dbf = head + b"    1caf\xe9 20240102T" + b"*   2gone 20240102F" + b"     " + b"     " + b"        " + b" "
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    body = struct.pack("<i32x2i2i", 5, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in square + hole)
    shapes = [body, struct.pack("<i2d", 1, 5.0, 6.0), struct.pack("<i", 0)]
    shp = bytes(100) + b"".join(struct.pack(">2I", k, len(b) // 2) + b for k, b in enumerate(shapes, 1))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("p/a.dbf", dbf)
        z.writestr("p/a.shp", shp)
    (tmp_path / "a.zip").write_bytes(packed.getvalue())
    rows = sorted(shapefiles.read_shapefiles(spark, str(tmp_path)).collect(), key=lambda r: r.rec)
    assert [(r.rec, r["values"]) for r in rows] == [(1, {"ID": "1", "NAME": "café", "DAY": "2024-01-02", "OK": "True"}), (3, {"ID": None, "NAME": None, "DAY": None, "OK": None})]
    assert '"Polygon"' in rows[0].geometry and rows[0].geometry.count("[1.0, 1.0]") == 2 and rows[1].geometry is None


def test_geometry_round_trips():
    poly = G.parse_wkt("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1)),((9 9,10 9,10 10,9 9)))")
    assert G.parse_any(G.write_ewkb(poly)) == poly and G.area(poly) == 15.5 and G.bounds(poly) == (0, 0, 10, 10)
    assert G.parse_wkt("POINT(1 2)")["parts"] == [[[(1.0, 2.0)]]] and G.parse_wkt("CIRCLE(1)") is None and G.parse_ewkb("00ff") is None
    for lon, lat in ((-56.2, -34.9), (-57.0, -30.1), (-53.5, -33.0)):
        e, n = G.utm_forward(lon, lat)
        assert math.dist(G.to_degrees(e, n), (lon, lat)) < 1e-8
    assert G.degenerate(G.parse_wkt("LINESTRING(1 1,1 1)")) and not G.degenerate(G.parse_wkt("LINESTRING(1 1,1 2)")) and G.degenerate(G.parse_wkt("POLYGON((0 0,0 1,0 2,0 0))"))


def test_rings_compare_whatever_their_start():
    rng = random.Random(1)
    for _ in range(50):
        ring = [(math.cos(a) * 3 + rng.random() / 9, math.sin(a) * 3) for a in sorted(rng.random() * 6.28 for _ in range(7))]
        k = rng.randrange(7)
        other = (ring[k:] + ring[:k])[:: rng.choice((1, -1))]
        a, b = ({"type": t, "parts": [[r + r[:1]]]} for t, r in (("Polygon", ring), ("MultiPolygon", other)))
        assert G.compare(a, b)
        moved = {"type": "Polygon", "parts": [[[(x + 0.01, y) for x, y in ring]]]}
        assert not G.compare(a, moved)
    assert G.compare(None, None) and not G.compare(None, {"type": "Point", "parts": [[[(1, 1)]]]})


def test_clip_areas_add_up():
    rng = random.Random(3)
    for _ in range(100):
        a = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(3)]
        left = G.clip_convex(a, [(0, 0), (2, 0), (2, 4), (0, 4)])
        right = G.clip_convex(a, [(2, 0), (4, 0), (4, 4), (2, 4)])
        total = sum(abs(G.shoelace(r)) for r in (left, right) if r)
        assert abs(total - abs(G.shoelace(a))) < 1e-9
    assert [G.locate(*p, [(0, 0), (4, 0), (4, 4), (0, 4)]) for p in ((1, 1), (4, 2), (5, 5))] == [1, 0, -1]


def test_same_geometry_columns(spark):
    rows = [("POLYGON((0 0,1 0,1 1,0 0))", "POLYGON((1 0,1 1,0 0,1 0))"), ("POINT(1 1)", "POINT(1 2)"), (None, "POINT(1 1)")]
    assert one(spark, "a string, b string", rows, G.same_geometry(F.col("a"), F.col("b"))) == [(True,), (False,), (False,)]


def test_hot_key_reconciles(spark):
    cfg = reconcile.ReconcileConfig(keys=("k",), compared=("v",))
    t = spark.range(3000).selectExpr("case when id < 1000 then 'hot' else cast(id as string) end as k", "'x' as v", "id as rec")
    found = reconcile.items(t, t, cfg)
    assert {r.type: r.n for r in found.groupBy("type").agg(F.sum("n_rows").alias("n")).collect()} == {"MATCH": 2001, "DUPLICATE_SUID": 999, "SKIPPED_TWIN": 999}
    assert reconcile.summary(found).first().n_rows == 6000


def test_geometry_decides_the_type(spark):
    cfg = reconcile.ReconcileConfig(keys=("a", "b"), compared=("v",), geometry="g")
    t = spark.createDataFrame([("k", None, "x", "POINT(1 1)", 1), ("k", "2", "x", "POINT(1 1)", 2), ("k", "3", "x", "POINT(1 1)", 3)], "a string, b string, v string, g string, rec long")
    s = spark.createDataFrame([("K", None, "y", "POINT(1 2)", 1), ("k", "2", "y", "POINT (1 1)", 2), ("k", "3", "x", "POINT(5 1)", 3), ("o'n", "4", None, None, 4)], t.schema)
    found = reconcile.items(t, s, cfg)
    got = {r.key: (r.type, [d.field for d in r.differences or []]) for r in found.collect()}
    assert got == {"k|": ("GEOMETRY_MISMATCH", ["v"]), "k|2": ("ATTRIBUTE_MISMATCH", ["v"]), "k|3": ("GEOMETRY_MISMATCH", []), "o'n|4": ("ONLY_IN_SHP", [])}
    said = {r.key: r.statement for r in reconcile.sql_patches(found, t, s, "x", cfg).collect()}
    assert said["k|"] == """UPDATE "x" SET "v" = 'y', "g" = ST_GeomFromText('POINT(1 2)', 4326) WHERE "a" = 'k' AND "b" IS NULL""" and said["o'n|4"] == """INSERT INTO "x" ("a", "b", "v", "g") VALUES ('o''n', '4', NULL, NULL)"""
    assert said["k|3"] == """UPDATE "x" SET "g" = ST_GeomFromText('POINT(5 1)', 4326) WHERE "a" = 'k' AND "b" = '3'"""


def test_canonical_keys_are_shapes():
    """Two rings share a key just if one is the other turned or reversed, after rounding; repeated vertices included."""
    rng, key = random.Random(8), lambda *rings, t="Polygon": G.canonical({"type": t, "parts": [list(rings)]})
    for _ in range(300):
        ring = [(rng.randrange(3) / 2, rng.randrange(3) / 2) for _ in range(rng.randrange(3, 7))]
        ring = [p for p, q in zip(ring, ring[-1:] + ring[:-1]) if p != q]
        other = [(rng.randrange(3) / 2, rng.randrange(3) / 2) for _ in range(len(ring))]
        other = [p for p, q in zip(other, other[-1:] + other[:-1]) if p != q]
        if len(ring) < 3 or len(other) < 3:
            continue
        k = rng.randrange(len(ring))
        turned = (ring[k:] + ring[:k])[:: rng.choice((1, -1))]
        assert key(ring + ring[:1]) == key(turned) == key([(x + 0.00002, y) for x, y in turned], t="MultiPolygon")
        assert (key(ring) == key(other)) == G.rings_match(ring, other, 0.0)
    a, b = [(0, 0), (9, 0), (9, 9)], [(1, 1), (2, 1), (2, 2)]
    assert key(a, b) == key(b[::-1], a) != key(a)
    line = lambda *p: G.canonical({"type": "LineString", "parts": [[list(p)]]})
    assert line((0, 0), (1, 1)) != line((1, 1), (0, 0)) and line((0, 0)) != G.canonical({"type": "Point", "parts": [[[(0, 0)]]]})


def test_repeated_keys_with_shapes(spark):
    """Equal attributes pair where a side has no place; nearest rows pair else; what faces several others is a duplicate."""
    cfg = reconcile.ReconcileConfig(keys=("k",), compared=("v",), geometry="g")
    schema = "k string, v string, g string, rec long"
    point = lambda x: f"POINT({x} 0)"
    t = spark.createDataFrame([("a", "x", point(0), 1), ("a", "y", point(9), 2), ("b", "x", None, 3), ("b", "y", None, 4), ("c", "x", point(1), 5), ("c", "x", point(1), 6), ("d", "p", None, 7), ("d", "q", None, 8), ("e", "x", "LINESTRING(1 1,1 1)", 9)], schema)
    s = spark.createDataFrame([("a", "x", point(8), 1), ("a", "z", point(1), 2), ("b", "y", point(5), 3), ("b", "w", point(5), 4), ("c", "x", point(1), 5), ("d", "r", None, 6), ("d", "s", point(2), 7), (None, "x", point(1), 8), ("e", "x", "LINESTRING(1 1,1 1)", 9), (None, None, "LINESTRING(2 2,2 2)", 10)], schema)
    found = reconcile.items(t, s, cfg)
    got = sorted((r.key or "", r.type, [d.field for d in r.differences or []], r.db_rec or 0, r.file_rec or 0) for r in found.collect())
    assert got == sorted([
        ("a", "GEOMETRY_MISMATCH", ["v"], 1, 2), ("a", "GEOMETRY_MISMATCH", ["v"], 2, 1), ("b", "GEOMETRY_MISMATCH", [], 4, 3), ("b", "GEOMETRY_MISMATCH", ["v"], 3, 4), ("c", "MATCH", [], 5, 5), ("c", "DUPLICATE_SUID", [], 6, 0),
        *[("d", "DUPLICATE_SUID", [], a, b) for a, b in ((7, 0), (8, 0), (0, 6), (0, 7))], ("", "NULL_SUID", [], 0, 8), ("e", "ONLY_IN_DB", [], 9, 0), ("e", "DEGENERATE", [], 0, 9), ("", "DEGENERATE", [], 0, 10),
    ])
    assert reconcile.summary(found).first().n_rows == 19


def test_geometry_of_delimited_rows(spark):
    rows = [("POINT(1 2)", "5", "6"), ("nothing", " -34.5 S", "-56.25x"), ("", "6140000", "600000"), (None, "x", "1"), (None, None, "1"), (None, ".5", "1e1"), ("POINT(", "", "")]
    df = spark.createDataFrame([({"Geom": g, "lat": a, "lon": b},) for g, a, b in rows], "v map<string,string>")
    got = [r.g for r in df.select(text_files.row_geometry(F.col("v"), {"geometry": "Geom", "lat": "lat", "lng": "lon"}).alias("g")).collect()]
    assert got[:2] == ["POINT(1 2)", "POINT(-56.25 -34.5)"] and got[3:] == [None, None, "POINT(10.0 0.5)", None]
    (x, y), = G.parse_wkt(got[2])["parts"][0][0]
    assert (round(x, 3), round(y, 3)) == tuple(round(v, 3) for v in G.utm_inverse(600000, 6140000))
    assert [r.g for r in df.select(text_files.row_geometry(F.col("v"), {}).alias("g")).collect()] == [None] * 7
