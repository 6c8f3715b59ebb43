"""Layer operators on small tables against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G, overlay as O
from tessella.operators import layers

SQUARE = "POLYGON(({0} {1},{2} {1},{2} {3},{0} {3},{0} {1}))"


def box(x, y, w, h):
    return SQUARE.format(x, y, x + w, y + h)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, "hot" if k % 3 else f"k{k % 7}", box(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9), rng.randrange(1, 9))) for k in range(300)]
    return out + [(400, None, box(0, 0, 1, 1)), (401, "k1", None), (402, "k1", "POINT(1 2)"), (403, "k2", "no geometry"), (404, "alone", "POLYGON((0 0,4 4,4 0,0 4,0 0))"), (405, "flat", "POLYGON((0 0,4 0,0 0))")]


def cells(text):
    if text is None or not text.startswith("POLYGON") or text.count(",") != 4:
        return set()
    x1, y1, x2, y2 = map(int, O.bounds(G.parse_wkt(text)))
    return {(x, y) for x in range(x1, x2) for y in range(y1, y2)} if "4 4,4 0" not in text else set()


@pytest.mark.parametrize("fan", [4, 64])
def test_hot_keys_are_merged_in_rounds(spark, rows, fan):
    df = layers.examined(spark.createDataFrame(rows, "rec long, key string, g string"), "g").where("geom is not null and key is not null")
    for how in ("union", "parity"):
        got = {r.key: r for r in layers.merged(df, "key", "rec", how, fan).collect()}
        want: dict = {}
        near: dict = {}
        touch = set()
        for _, k, g in rows:
            if k and (c := cells(g)):
                around = {(x + a, y + b) for x, y in c for a, b in ((0, 0), (1, 0), (0, 1), (-1, 0), (0, -1))}
                touch |= {k} if around & near.get(k, set()) else set()
                near[k] = near.get(k, set()) | c
                want[k] = want.get(k, set()) | c if how == "union" else want.get(k, set()) ^ c
        for k, c in want.items():
            assert got[k].area == pytest.approx(len(c), abs=1e-6) and got[k].collided == (how == "parity" and k in touch)
            assert O.invalid_reason(G.parse_wkt(got[k].geom)) is None
        assert got["alone"].area == pytest.approx(8) and not got["alone"].collided and "flat" not in got


def test_examined_tells_why(spark, rows):
    got = {r.rec: (r.invalid, r.reason, r.area) for r in layers.examined(spark.createDataFrame(rows, "rec long, key string, g string"), "g").collect()}
    assert got[401] == (False, None, None) and got[402] == (False, None, 0.0) and got[403] == (True, "unreadable", None)
    assert got[404] == (True, "edges cross", 8.0) and got[405] == (True, "too few points", None)
    raw = {r.rec: (r.invalid, r.geom) for r in layers.examined(spark.createDataFrame(rows, "rec long, key string, g string"), "g", False).collect()}
    assert raw[404] == (True, "POLYGON((0 0,4 4,4 0,0 4,0 0))")


def test_process_reports(spark):
    rows = [(1, "a", box(0, 0, 4, 4)), (2, "a", box(4, 0, 4, 4)), (3, "b", box(7, 3, 4, 4)), (4, "c", box(20, 20, 1, 1)), (5, "c", box(30, 20, 1, 1)), (6, None, box(7, 3, 1, 1)), (7, "d", "POLYGON((0 0,9 0,0 0))"), (8, "e", "POLYGON((50 50,54 54,54 50,50 54,50 50))")]
    layer, report = layers.process(spark.createDataFrame(rows, "rec long, k string, g string"), "g", layers.LayerConfig(keys=("k",), single_part=True, least_area=0.5))
    assert {r.rec: r.area for r in layer.collect()} == {1: 32.0, 3: 16.0, 4: 2.0, 6: 1.0, 7: None, 8: 8.0}
    facts = {r.measure: r.value for r in report.collect()}
    assert facts == {"invalid_before": 2, "repaired": 3, "empty_after_repair": 1, "incompatible": 2, "inserted_invalid": 0, "inserted_rows": 6, "groups": 2, "rows_merged": 2, "null_key_rows": 1, "overlaps": 3, "would_block": 1}
    _, kept = layers.process(spark.createDataFrame(rows, "rec long, k string, g string"), "g", layers.LayerConfig(repair=False, block=False))
    facts = {r.measure: r.value for r in kept.collect()}
    assert facts == {"invalid_before": 2, "repaired": 0, "empty_after_repair": 0, "incompatible": 0, "inserted_invalid": 2, "inserted_rows": 8, "overlaps": 0, "would_block": 0}
    empty, nothing = layers.process(spark.createDataFrame([], "rec long, k string, g string"), "g", layers.LayerConfig(keys=("k",)))
    assert empty.count() == 0 and {r.value for r in nothing.collect()} == {0}


def test_union_by_key_without_repair(spark):
    rows = [(1, "a", "x", box(0, 0, 4, 4)), (2, "a", None, box(2, 0, 4, 4)), (3, "b", "z", "POLYGON((0 0,4 4,4 0,0 4,0 0))")]
    df = spark.createDataFrame(rows, "rec long, k string, v string, g string")
    got = {r.k: r for r in layers.union_by_key(df, "g", ["k"], ["v"], repair=False).collect()}
    assert (got["a"].area, got["a"].rec, got["a"].v, got["a"].n_rows) == (24.0, 1, "x", 2) and got["b"].geom == rows[2][3]
    assert layers.union_by_key(df.limit(0), "g", ["k"], ["v"]).count() == 0


def test_pairs_with_area(spark):
    a = layers.examined(spark.createDataFrame([(1, box(0, 0, 4, 4)), (2, box(100, 0, 1, 1))], "i long, g string"), "g")
    b = layers.examined(spark.createDataFrame([(7, "POLYGON((2 2,10 2,2 10,2 2))"), (8, box(4, 0, 1, 1))], "i long, g string"), "g")
    assert [tuple(r) for r in layers.pairs_with_area(a, b, "i", "i", 3.0).collect()] == [(1, 7, 4.0)]


def test_subdivision_as_rows(spark):
    ring = ",".join(f"{x} {(x * x) % 17 + 5}" for x in range(200))
    df = layers.examined(spark.createDataFrame([(1, f"POLYGON((0 0,{ring},199 0,0 0))"), (2, None)], "i long, g string"), "g")
    found = layers.subdivided(df, ["i"], 16)
    assert found.agg(F.sum("area")).first()[0] == pytest.approx(df.agg(F.sum("area")).first()[0], rel=1e-6)
    assert found.agg(F.max("n_vertices")).first()[0] <= 16 and found.count() > 13
