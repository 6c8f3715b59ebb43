"""Greedy pairing by distance against the plain algorithm over all edges."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessella.functions import geometry as G
from tessella.operators import pairing as P

SCHEMA = "key string, rec long, x double, y double, attributes array<string>, line array<double>"


def greedy(t, s):
    """Sorts all edges and takes the first free one."""
    def far(a, b):
        d = np.hypot(a[2] - b[2], a[3] - b[3])
        if a[5] and b[5]:
            d = G.distance(*({"type": "LineString", "parts": [[list(zip(r[5][::2], r[5][1::2]))]]} for r in (a, b))) if (a[2], a[3], b[2], b[3]) == (0, 0, 0, 0) else max(d, hausdorff(a[5], b[5]))
        return d

    edges = sorted((np.floor(far(a, b) / 1e-4 + 0.5), sum(u != v for u, v in zip(a[4], b[4])), a[1], b[1], float(far(a, b))) for a in t for b in s if a[0] == b[0] and None not in (a[2], b[2], a[0]))
    used, out = (set(), set()), []
    for _, _, a, b, d in edges:
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, round(d, 9)))
    return sorted(out)


def hausdorff(a, b):
    p, q = np.array(a).reshape(-1, 2), np.array(b).reshape(-1, 2)
    m = np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1))
    return max(m.min(1).max(), m.min(0).max())


def rows(rng, n, start, key="k", spread=10, decimals=1, lines=False):
    out = []
    for k in range(n):
        x, y = round(rng.uniform(0, spread), decimals), round(rng.uniform(0, spread), decimals)
        line = [x - 1, y, x + 1, y + rng.choice([0.0, 0.5]), x, y + 2] if lines and k % 2 else None
        out.append((key, start + k, x, y, [rng.choice("ab"), rng.choice("cd")], line))
    return out


def points(t, s):
    table = pa.table({"key": [r[0] for r in t + s], "side": [0] * len(t) + [1] * len(s), "rec": [r[1] for r in t + s], "x": [r[2] for r in t + s], "y": [r[3] for r in t + s], "attributes": [r[4] for r in t + s], "line": pa.array([r[5] for r in t + s], pa.list_(pa.float64()))})
    return P.sides(table)[:2]


@pytest.mark.parametrize("seed", range(25))
def test_chains_equal_greedy(seed):
    rng = random.Random(seed)
    t, s = rows(rng, rng.randrange(1, 40), 0, decimals=seed % 3, lines=seed % 2), rows(rng, rng.randrange(1, 40), 1000, decimals=seed % 3, lines=seed % 2)
    assert sorted((a, b, round(d, 9)) for a, b, d in P.chained(*points(t, s))) == greedy(t, s)


def test_certain_pairs_are_greedy_ones():
    """With rows cut off at a border, only pairs of the whole come out; with all rows, all pairs."""
    rng = random.Random(5)
    for k in range(30):
        t, s = rows(rng, 60, 0, decimals=k % 3), rows(rng, 60, 1000, decimals=k % 3)
        want = {x[:2] for x in greedy(t, s)}
        a, b = points([r for r in t if r[2] < 6], [r for r in s if r[2] < 6])
        room = lambda p: 6 - p.xy[:, 0]
        got = {(int(a.rec[i]), int(b.rec[j])) for i, j, _ in P.certain(a, b, 2.5, room(a), room(b))}
        assert got <= want and len(got) > 8
        a, b = points(t, s)
        free = np.full(60, np.inf)
        assert {(int(a.rec[i]), int(b.rec[j])) for i, j, _ in P.certain(a, b, 50.0, free, free)} == want


def test_keys_of_all_sizes(spark):
    rng = random.Random(9)
    t, s = [], []
    for k in range(12):
        t += rows(rng, rng.randrange(0, 7), len(t), f"k{k}")
        s += rows(rng, rng.randrange(0, 7), len(s), f"k{k}", lines=k == 3)
    t += rows(rng, 700, 5000, "big", 100, 2) + rows(rng, 200, 8000, "spot", 3, 0) + [("k1", 9000, None, 1.0, ["a", "c"], None), (None, 9001, 1.0, 1.0, ["a", "c"], None)]
    s += rows(rng, 650, 5000, "big", 100, 2) + rows(rng, 260, 8000, "spot", 3, 0) + [("k2", 9000, 1.0, float("nan"), ["a", "c"], None), ("far", 9002, 0.0, 0.0, ["a", "c"], None)]
    a, b = spark.createDataFrame(t, SCHEMA), spark.createDataFrame(s, SCHEMA)
    found = P.nearest_pairs(a, b).collect()
    by = lambda m: sorted((r.db_rec, r.file_rec, round(r.distance, 9)) for r in found if r.method == m)
    ok = [r for r in s if r[3] == r[3]]
    want = sorted(sum((greedy([r for r in t if r[0] == k], [r for r in ok if r[0] == k]) for k in {r[0] for r in t}), []))
    assert by("GEOMETRY") == want
    # Every row of both sides comes back once.
    assert sorted(r.db_rec for r in found if r.db_rec is not None) == sorted(r[1] for r in t if r[0])
    assert sorted(r.file_rec for r in found if r.file_rec is not None) == sorted(r[1] for r in s)
    small = P.settled(a.selectExpr("key", "0 as side", "rec", "x", "y", "attributes", "line").union(b.selectExpr("key", "1", "rec", "x", "y", "attributes", "line")).where("key = 'big' or key = 'spot'"))
    blocks = sorted((r.db_rec, r.file_rec, round(r.distance, 9)) for r in P.by_distance(small, 60, 64).collect())
    assert blocks == [w for w in want if w[0] >= 5000]


def test_what_is_left_over(spark):
    make = lambda *r: spark.createDataFrame([(k, i, x, 0.0, ["a"], None) for k, i, x in r], SCHEMA)
    found = P.nearest_pairs(make(("a", 1, 0.0), ("a", 2, None), ("b", 3, None), ("b", 4, None), ("c", 5, 1.0)), make(("a", 11, 0.5), ("a", 12, None), ("b", 13, 2.0)))
    assert sorted((r.key, r.method, r.db_rec or 0, r.file_rec or 0) for r in found.collect()) == [("a", "ELIMINATION", 2, 12), ("a", "GEOMETRY", 1, 11), ("b", "AMBIGUOUS", 0, 13), ("b", "AMBIGUOUS", 3, 0), ("b", "AMBIGUOUS", 4, 0), ("c", "UNPAIRED", 5, 0)]
    assert P.nearest_pairs(make(("a", 1, 0.0)).limit(0), make(("a", 1, 0.0)).limit(0)).count() == 0


def test_a_key_of_a_hundred_thousand_rows_ends(spark):
    df = spark.range(100_000).selectExpr("'k' as key", "id as rec", "pmod(xxhash64(id), 1000003) / 100d as x", "pmod(xxhash64(id, 7), 1000003) / 100d as y", "array(string(id % 3)) as attributes")
    s = df.selectExpr("key", "rec", "x + 0.01 * (rec % 5) as x", "y", "attributes").where("rec % 10 <> 0")
    begin = time.time()
    found = P.nearest_pairs(df, s)
    counts = {r.method: r["count"] for r in found.groupBy("method").count().collect()}
    assert counts == {"GEOMETRY": 90_000, "UNPAIRED": 10_000} and time.time() - begin < 120
