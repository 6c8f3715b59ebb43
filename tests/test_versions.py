"""Versions of a table: what passes, what is refused, what comes back."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedup, versions


@pytest.fixture()
def store(spark, tmp_path):
    return versions.Versions(spark, str(tmp_path / "t"))


def test_replace_refuse_revert(spark, store):
    assert store.read() is None and store.commits() == []
    gates = [versions.ratio_gate(), versions.unique_gate(["k"])]
    first = store.replace(spark.range(100).selectExpr("id as k", "1 as v"), gates)
    for bad, why in ((spark.range(90).selectExpr("id as k", "2 as v"), "90 rows for 100"), (spark.range(100).selectExpr("id % 99 as k", "2 as v"), "1 keys repeat, 0 rows"), (spark.range(100).selectExpr("if(id < 98, id, null) as k", "2 as v"), "0 keys repeat, 2 rows"), (spark.range(0).selectExpr("id as k", "2 as v"), "too few")):
        with pytest.raises(versions.Refused, match=why):
            store.replace(bad, gates)
        assert store.read().agg(F.sum("v")).first()[0] == 100 and len(store.commits()) == 1
    second = store.replace(spark.range(98).selectExpr("id as k", "2 as v"), gates)
    assert store.read().agg(F.sum("v")).first()[0] == 196 and store.read(first).count() == 100
    store.revert(first)
    assert [(n, v) for n, v, _ in store.commits()] == [(1, first), (2, second), (3, first)] and store.read().count() == 100
    with pytest.raises(versions.Refused):
        store.revert("nothing")
    assert len(list((__import__("pathlib").Path(store.root) / "data").iterdir())) == 2


def test_gates_over_facts(spark, store):
    check = lambda old, new: old.agg(F.sum("id").alias("a")).join(new.agg(F.sum("id").alias("b"))).withColumn("passes", F.col("a") == F.col("b"))
    store.replace(spark.range(5), [versions.facts_gate(check)])
    with pytest.raises(versions.Refused, match="a 10, b 6, passes False"):
        store.replace(spark.range(4), [versions.facts_gate(check)])
    store.replace(spark.range(4), [versions.facts_gate(check, spark.range(4))])


def test_decisions_in_order(spark):
    """Each rule alone, and which goes first."""
    rows = [
        ("a", "u:9", "P", True, False), ("a", "u:5", "I", False, False), ("a", "u:3", "I", False, False), ("b", "u:1", "I", True, False), ("b", "u:2", "I", False, False), ("b", "u:4", "I", False, True), ("c", "u:7", "I", False, True),
        ("d", "u:x", "I", False, False), ("d", "u:20", "I", False, False), ("d", "u:8", "M", False, True), (None, "u:6", "I", False, False),
    ]
    df = spark.createDataFrame(rows, "match_key string, urn string, source string, matched boolean, has_units boolean")
    reasons = lambda beside: {r.urn: r.reason for r in dedup.decide_by_source(df, ["I"], ["P"], beside).collect()}
    assert reasons(False) == {
        "u:9": "PROTECTED_SOURCE", "u:5": "REDUNDANT_NOT_LOWEST_URN", "u:3": "KEPT_ALONGSIDE_PROTECTED", "u:1": "INFRA_MATCHED", "u:2": "REDUNDANT_WITH_MATCHED", "u:4": "HAS_INTERNAL_UNITS", "u:7": "NO_DUPLICATE",
        "u:x": "REDUNDANT_NOT_LOWEST_URN", "u:20": "LOWEST_URN_KEPT", "u:8": "REDUNDANT_NOT_LOWEST_URN",
    }
    assert {u for u, r in reasons(True).items() if r == "REDUNDANT_WITH_PROTECTED"} == {"u:5", "u:3"}
    shown = dedup.reported(dedup.decide_by_source(df, ["I"], ["P"]))
    assert {(r.match_key, r.group_id) for r in shown.collect()} == {("a", 1), ("b", 2), ("d", 3)}
    assert {r.urn for r in shown.where("decision = 'REMOVE'").collect()} == {"u:5", "u:2", "u:x", "u:8"}
