"""The line field: exact marginals, held-out accuracy, defined results for odd rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality, registry


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    unary, transition, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, expected, log_z = quality.marginals(unary, first, transition)
    total, want, moves = 0.0, np.zeros(7), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        paths = {p: np.exp(sum(unary[a + i] * s for i, s in enumerate(p)) + sum(transition[x, y] for x, y in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=b - a)}
        z = sum(paths.values())
        total += np.log(z)
        for p, v in paths.items():
            want[a:b] += np.array(p) * v / z
            for x, y in zip(p, p[1:]):
                moves[x, y] += v / z
    assert np.allclose(good, want) and np.allclose(expected, moves) and np.isclose(log_z, total)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = registry.QUERIES["op1_line_field_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    right = np.mean([r.predicted == r.quality for r in rows])
    keeps = np.mean([r.predicted for r in rows if r.quality == 1])
    assert right >= 0.95 and keeps >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "word " * 50_000), (5, "é\n!\n"), (5, "é\n!\n"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.train(docs, labels.limit(0)) == 0.5
    assert quality.score(docs.limit(0), 0.5).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
