"""Running totals, numbers, mergeable fingerprints and capped samples against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedup, grouping, joins, loads, numbering, upserts


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(None if k % 50 == 7 else "hot" if k % 3 else f"k{k % 9}", k, rng.randrange(1, 40)) for k in rng.sample(range(4000), 1500)]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_running_totals_of_hot_keys(spark, rows, ranges):
    df = spark.createDataFrame(rows, "g string, i int, w long").repartition(5)
    got = {(r.g, r.i): r.total for r in numbering.running_total(df, ["g"], ["i"], "w", ranges=ranges).collect()}
    sums: dict = {}
    for g, i, w in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + w
        assert got[g, i] == sums[g]
    assert len(got) == len(rows)
    numbers = numbering.numbered(df, ["i"], ranges=ranges).collect()
    assert [r.n for r in sorted(numbers, key=lambda r: r.i)] == list(range(1, len(rows) + 1))


def test_numbers_of_little(spark):
    empty = spark.createDataFrame([], "g string, i int, w long")
    assert numbering.numbered(empty, ["i"]).count() == 0 and numbering.running_total(empty, ["g"], ["i"], "w").count() == 0
    ties = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 1, 2)], "g string, i int, w long")
    assert sorted(r.total for r in numbering.running_total(ties, ["g"], ["i"], "w", ranges=3).collect()) == [2, 4, 6]


def test_batches_and_group_ids(spark, rows):
    df = spark.createDataFrame(rows, "g string, i int, w long")
    got = {(r.g, r.i): r.batch for r in loads.batches(df, ["g"], ["i"], "w", 100).collect()}
    total = 0
    for g, i, w in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1]):
        total += w
        assert got[g, i] == (total - 1) // 100
    ids = {r.g: r.group_id for r in dedup.with_group_ids(df.where("g is not null"), "g").select("g", "group_id").distinct().collect()}
    assert ids == {g: k for k, g in enumerate(sorted(ids), 1)}


def test_fingerprints_merge(spark, rows):
    df = spark.createDataFrame(rows, "g string, i int, w long")
    columns = ["g", "i", "w"]
    text = lambda state: grouping.fingerprint_text(state).first().fingerprint
    state = lambda d: grouping.multiset_state(d, columns)
    whole = text(state(df))
    assert whole == text(state(df.repartition(13))) == text(state(df.orderBy("w").coalesce(1)))
    assert whole == text(grouping.changed_state(state(df.where("i < 100")), state(df.where("i >= 50")), state(df.where("i >= 50 and i < 100"))))
    assert len({whole, text(state(df.union(df.limit(1)))), text(state(df.limit(len(rows) - 1))), text(state(df.withColumn("g", F.coalesce("g", F.lit("n")))))}) == 4
    assert text(state(df.limit(0))) == "0-0-0-0-0"
    swapped = spark.createDataFrame([("a", "bc"), ("", None)], "x string, y string"), spark.createDataFrame([("ab", "c"), (None, "")], "x string, y string")
    assert len({text(grouping.multiset_state(d, ["x", "y"])) for d in swapped}) == 2


def test_kinds_and_values_have_no_cap(spark):
    df = spark.range(3000).selectExpr("if(id % 100 = 99, null, id % 100) as kind", "id")
    got = upserts.preview(df, "kind", ["id"], 2).collect()
    assert len(got) == 200 and {r.n_total for r in got} == {30} and sum(r.kind is None for r in got) == 2
    many = spark.range(5000).selectExpr("id % 2 as k", "if(id < 4, null, cast(id as string)) as v", "id as rec")
    first = grouping.conflict_samples(many, ["k"], "v", 20).collect()
    assert [(r.k, r.kept, r.n_values, r.samples) for r in first] == [(0, None, 2498, "10,100,1000,1002,1004"), (1, None, 2498, "1001,1003,1005,1007,1009")]
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 9), (4, 10)], "a int, b int")
    assert [tuple(r) for r in joins.mutual_unique(pairs, "a", "b").collect()] == [(4, 10)]
