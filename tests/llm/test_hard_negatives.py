"""Hard negatives against brute force and SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hard_negatives, registry

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    from math import floor, isfinite

    good = [(i, [floor(256 * x) if abs(x) < 2**45 else int(x) * 256 for x in v], c) for i, v, c, _ in rows if i is not None and c is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for i, v, c in good:
        if not anchors(i):
            continue
        scored = sorted(((-dot(v, w), j, d) for j, w, d in good if j != i), key=lambda x: x[:2])
        for p, j, _ in [x for x in scored if x[2] == c][:positives]:
            fits = [x for x in scored if x[2] != c and low * -p <= 100 * -x[0] <= high * -p]
            out += [(i, j, k, x[1], clip(-p), clip(-x[0])) for k, x in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 5 == 0, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 50)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_BLOCK", 20)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(k, [x + rng.gauss(0, 0.3) for x in centres[k % 4]], rng.choice([k % 4, 1]), "x") for k in range(300)]
    rows += [(None, [1.0] * 8, 1, None), (600, None, 1, None), (605, [1.0, None], 2, None), (610, [float("nan")] * 8, 3, None), (615, [1.0] * 8, None, None), (620, [], 1, None), (625, [2.0, 2.0], 1, None), (630, [1.0] * 11, 2, None), (635, [0.0] * 8, 3, None)]
    rows += rows[:7] + rows[:3] + [(640, rows[4][1], 0, None)] * 3
    rows += [(700, [1e300] + [0.5] * 7, 2, None), (701, [3e5] * 8, 2, None), (705, [-2.0**60, 1.0], 1, None), (706, [1.0, 1e9], 0, None)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows, lambda i: i % 5 == 0)


def test_odd_tables(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0], 1, None) for k in range(12)], SCHEMA)
    assert mined(df) == [] == mined(df.limit(0))
    rows = [(k, [1.0, 2.0 if k % 2 else 1.2], k % 2, None) for k in range(12)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == want and want
    assert mined(spark.createDataFrame(rows, SCHEMA), positives=2, negatives=1, low=10) == brute(rows, lambda i: i % 5 == 0, 2, 1, 10)


def test_brackets_hold_every_score():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(0, 40, (400, 12)))
    top2 = (rows**2).sum(1).max()
    pivots = hard_negatives.Pivots(rows[:64], top2)
    assert len(pivots.values) == hard_negatives.PIVOTS
    stored, asked = pivots.of_rows(rows), pivots.of_anchors(rows)
    d = np.sqrt((rows**2).sum(1)[:, None] + top2 - 2 * rows @ rows.T)
    assert (np.abs(asked[:, None] - stored[None]).max(2) <= d + 1e-6).all() and ((asked[:, None] + stored[None]).min(2) >= d - 1e-6).all()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = registry.QUERIES["op12_hard_negatives"](spark, sf)
    found = con.execute(registry.ORACLE["op12_hard_negatives"])
    assert df.columns == [d[0] for d in found.description]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(found.fetchall()) and len(got) > 50
