"""Lines against dense samples, and street networks against plain loops."""

import math
import random

import numpy as np
import pytest

from tessella.functions import geometry as G, lines as L
from tessella.operators import axes, spatial


def line(*points):
    return {"type": "LineString", "parts": [[list(points)]]}


def far(p, s):
    a, b, c, d = s
    t = max(0, min(1, ((p[0] - a) * (c - a) + (p[1] - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
    return math.hypot(p[0] - a - t * (c - a), p[1] - b - t * (d - b))


def test_cover_equals_dense_samples():
    rng = random.Random(1)
    for _ in range(40):
        path = lambda n: line(*[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)])
        g, others, reach = path(4), [path(rng.randrange(2, 5)) for _ in range(rng.randrange(1, 4))], rng.choice([0.3, 1, 2.5])
        around = [s for o in others for s in L.segments(o).tolist()]
        hit = total = 0
        for a, b, c, d in L.segments(g).tolist():
            size, n = math.hypot(c - a, d - b), 1500
            inside = sum(min(far((a + (c - a) * (k + 0.5) / n, b + (d - b) * (k + 0.5) / n), s) for s in around) <= reach for k in range(n))
            hit, total = hit + inside / n * size, total + size
        assert L.covered(g, others, reach) == pytest.approx(hit, abs=0.02 * total / 4) and L.length(g) == pytest.approx(total)
    straight = line((0, 0), (10, 0))
    assert L.covered(straight, [line((0, 0.5), (4, 0.5)), line((3, -0.5), (6, -0.5))], 0.5) == pytest.approx(6)
    assert L.covered(straight, [], 1) == 0 and L.covered(straight, [line((0, 5), (9, 5))], 1) == 0 and L.covered(straight, [line((2, 3), (2, 9))], 3) == pytest.approx(0)


def test_many_lines_at_once_are_what_each_is_alone(monkeypatch):
    """Lines of one place, several parts and no others beside them; in one run and in many."""
    rng = random.Random(4)
    place = lambda: (rng.uniform(0, 9), rng.uniform(0, 9)) if rng.random() < 0.7 else (rng.randint(0, 9), rng.randint(0, 9))
    some = lambda n: {"type": "MultiLineString", "parts": [[[place() for _ in range(n)]] for _ in range(rng.randint(1, 2))]}
    a, b = [some(rng.randint(1, 6)) for _ in range(400)], [some(rng.randint(1, 6)) for _ in range(400)]
    others = [[some(rng.randint(1, 5)) for _ in range(rng.randint(0, 4))] for _ in a]
    for pairs in (1 << 18, 200, 1):
        monkeypatch.setattr(L, "PAIRS", pairs)
        assert L.hausdorffs(a, b) == [L.hausdorff(x, y) for x, y in zip(a, b)]
        assert L.covers(a, others, 0.7) == pytest.approx([L.covered(x, o, 0.7) for x, o in zip(a, others)], abs=1e-12)
    assert L.hausdorffs([], []) == L.covers([], [], 1.0) == []


def test_distance_and_comparable_texts():
    a, b = line((0, 0), (10, 0)), line((0, 1), (5, 3), (10, 0))
    assert L.hausdorff(a, b) == 3 == L.hausdorff(b, a)
    whole, parts = line((0, 0), (1, 1), (2, 0), (3, 0)), {"type": "MultiLineString", "parts": [[[(3, 0), (2, 0)]], [[(0, 0), (1, 1.00001), (2, 0)]]]}
    assert L.comparable(whole) == L.comparable(parts) == L.comparable(line((3, 0), (2, 0), (1, 1), (0, 0)))
    assert L.comparable(whole) != L.comparable(line((0, 0), (1, 1), (2, 0)))
    star = {"type": "MultiLineString", "parts": [[[(0, 0), (1, 0)]], [[(0, 0), (0, 1)]], [[(0, 0), (-1, 0)]]]}
    assert len(L.joined(star)) == 3 and L.comparable(line((0, 0), (0, 0), (1, 0))) == L.comparable(line((0, 0), (1, 0)))


def wkt(*points):
    return "LINESTRING(" + ",".join(f"{x} {y}" for x, y in points) + ")"


def test_a_network_is_told_apart(spark):
    """Renumbered, split, merged, removed; unchanged, reversed, moved, renamed and new sections."""
    old = [
        ("1", "s", "A", wkt((0, 0), (10, 0))), ("2", "s", "A", wkt((0, 20), (10, 20))), ("3", "s", "A", wkt((0, 40), (10, 40))), ("4", "s", "A", wkt((0, 60), (30, 60))),
        ("5", "s", "A", wkt((0, 80), (10, 80))), ("6", "s", "A", wkt((10, 80), (20, 80))), ("7", "s", "A", wkt((0, 100), (10, 100))), ("8", "t", "A", wkt((0, 120), (10, 120))), ("9", "s", "A", wkt((0, 140), (30, 140))),
    ]
    new = [
        ("1", "s", "A", wkt((10, 0.00001), (0, 0))), ("2", "s", "B", wkt((0, 20), (10, 20))), ("3", "s", "A", wkt((0, 40), (10, 40.01))), ("41", "s", "A", wkt((0, 60.2), (14, 60.2))), ("42", "s", "A", wkt((14, 60.2), (30, 60.2))),
        ("56", "s", "A", wkt((0, 80.3), (20, 80.3))), ("77", "s", "A", wkt((10, 100.2), (0, 100.2))), ("88", "s", "A", wkt((0, 120), (10, 120))), ("91", "s", "A", wkt((0, 140), (9, 140))), ("92", "s", "A", wkt((9, 140), (20, 140))),
        ("x", "s", "A", wkt((0, 0), (1, 1))), ("1", "s", "C", wkt((5, 5), (6, 6))),
    ]
    schema = "ref string, street string, name string, geom string"
    found = axes.analysed(spark.createDataFrame(new, schema).select("ref", "street", "geom", "name"), spark.createDataFrame(old, schema).select("ref", "street", "geom", "name"), ["street", "name"])
    rows = lambda n, *c: sorted(tuple(r[x] for x in c) for r in found[n].collect())
    assert rows("renumbered", "old_ref", "new_ref") == [("7", "77")]
    assert [(r.old_ref, r.new_refs, round(r.coverage, 6)) for r in found["splits"].collect()] == [("4", ["41", "42"], 1.0)]
    assert [(r.new_ref, r.old_refs, round(r.coverage, 6)) for r in found["merges"].collect()] == [("56", ["5", "6"], 1.0)]
    assert rows("removed", "old_ref") == [("8",), ("9",)]
    flags = {r.ref: (r.is_new, r.attr_changed, r.geom_changed) for r in found["sections"].collect()}
    assert flags["2"] == (False, True, False) and flags["3"] == (False, False, True) and flags["88"][0] and "x" not in flags and flags["1"] == (False, False, False)
    assert {r.measure: r.value for r in axes.summary(found).collect()} == {"new": 7, "unchanged": 1, "attr": 1, "geom": 1, "both": 0, "renumbered": 1, "splits": 1, "merges": 1, "removed": 2}


def test_equal_shapes_on_both_sides_are_not_renumbered(spark):
    """Two candidates on one side tell nothing; empty tables give nothing."""
    schema = "ref string, street string, geom string"
    old = spark.createDataFrame([("1", "s", wkt((0, 0), (10, 0))), ("2", "s", wkt((0, 0.1), (10, 0.1)))], schema)
    new = spark.createDataFrame([("3", "s", wkt((0, 0.2), (10, 0.2)))], schema)
    found = axes.analysed(new, old, ["street"])
    assert not found["renumbered"].count() and [r.old_refs for r in found["merges"].collect()] == [["1", "2"]]
    found = axes.analysed(new.limit(0), old.limit(0), ["street"])
    assert all(df.count() == 0 for df in found.values())


def test_boxes_of_all_sizes_meet_once(spark):
    """From points to a country: the join equals all pairs, and no box makes more than a few rows."""
    rng = random.Random(4)
    rows = []
    for k in range(250):
        size = 10 ** rng.uniform(-3, 4)
        x, y = rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)
        rows.append((k, k % 3, x, y, x + size * rng.choice([0, 1]), y + size))
    rows += [(900, 0, 5.0, 5.0, 5.0, 5.0), (901, 1, 5.0, 5.0, 5.0, 5.0), (902, 0, -1e6, -1e6, 1e6, 1e6)]
    df = spark.createDataFrame(rows, "i int, g int, minx double, miny double, maxx double, maxy double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    got = [(r.a_i, r.b_i) for r in spatial.box_join(df, df, 7.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    other = df.where("i % 2 = 0")
    got = [(r.a_i, r.b_i) for r in spatial.box_join(df, other, 7.0, on=("g",)).collect()]
    group = {r[0]: r[1] for r in rows}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if b % 2 == 0 and group[a] == group[b]}
    own = spatial.levels(df, 7.0)
    assert spatial.cells(df.where("i = 902"), 7.0, own).count() <= 4 and spatial.cells(df, 7.0, []).count() <= 4 * len(rows)
    assert np.isfinite(own).all() and G.bounds(line((0, 1), (2, 3))) == (0, 1, 2, 3)
