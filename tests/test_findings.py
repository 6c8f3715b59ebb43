"""What larger and odder tables showed."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import overlay, values
from tessella.operators import axes, grouping, layers, pairing, reconcile, spatial, texts
from tessella.plans import loading, reconciling, reports


def test_a_shared_rec_goes_by_its_ties(spark):
    rows = [(1, 7, None if row == 5 else f"v{row}", row) for row in range(40, 4, -1)] + [(1, 8, "late", 0)]
    df = spark.createDataFrame(rows, "k int, rec long, v string, row long").repartition(5)
    assert [tuple(r) for r in grouping.unify(df, ["k"], ["v"], ties=("row",)).collect()] == [(1, 7, None, 37)]
    kept = grouping.conflict_samples(df.where("v is not null"), ["k"], "v", 5, ties=("row",)).first().kept
    assert kept == "v6"


def test_a_short_ring_is_told_simple_as_any_geometry(monkeypatch):
    random.seed(5)
    seen = set()
    for _ in range(1500):
        most = random.choice([4, 6, 1000, 0])
        ring = [(random.randint(0, most), random.randint(0, most)) if most else (random.random() * 1e6, random.random() * 1e-3) for _ in range(random.randint(3, 7))]
        geom = {"type": "Polygon", "parts": [[[*ring, ring[0]]]]}
        found = overlay.invalid_reason(geom)
        with monkeypatch.context() as m:
            m.setattr(overlay, "plainly_simple", lambda ring: False)
            assert overlay.invalid_reason(geom) == found
        seen.add((overlay.plainly_simple([*ring, ring[0]]), found is None))
    assert seen == {(True, True), (False, True), (False, False)} or seen == {(True, True), (False, False)}


def test_geometries_of_one_file_are_examined_by_many_tasks_once(spark):
    one = spark.createDataFrame([(k, f"POLYGON(({k} 0,{k + 1} 0,{k} 1,{k} 0))") for k in range(400)], "rec long, geom string").coalesce(1)
    found = layers.examined(one, "geom").where("geom is not null")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_examined(") == 1


def test_many_small_keys_are_paired_together(monkeypatch):
    """Some keys by the list of their edges, in blocks of few edges, others by chains: what each key gives alone."""
    rng, rows = random.Random(3), []
    for key in range(60):
        for side, most in ((0, rng.randint(0, 9)), (1, rng.randint(0, 9))):
            rows += [{"key": f"k{key}", "side": side, "rec": rng.randint(0, 5000) * 100 + len(rows) % 100, "x": float(rng.randint(0, 4)), "y": float(rng.randint(0, 4)), "attributes": [rng.choice("ab"), rng.choice(["c", None])], "line": None} for _ in range(most)]
    rng.shuffle(rows)
    schema = pa.schema([("key", pa.string()), ("side", pa.int32()), ("rec", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("attributes", pa.list_(pa.string())), ("line", pa.list_(pa.float64()))])
    table, want = pa.Table.from_pylist(rows, schema), []
    for key in sorted({r["key"] for r in rows}):
        t, s, _ = pairing.sides(pa.Table.from_pylist([r for r in rows if r["key"] == key], schema))
        want += [(key, *p) for p in pairing.chained(t, s)]
    for few, edges in ((1 << 12, 1 << 21), (1 << 12, 50), (20, 1 << 21), (0, 1 << 21)):
        monkeypatch.setattr(pairing, "FEW", few)
        monkeypatch.setattr(pairing, "EDGES", edges)
        assert sorted(tuple(r.values()) for r in pairing._whole_keys(table).to_pylist()) == sorted(want)


def test_an_empty_first_partition_is_no_record(spark, tmp_path):
    """A table whose only row group lies beyond the first split leaves the first written file with its header alone."""
    customers = spark.range(5_000_000_000, 5_000_060_000).select(F.col("id").alias("c_custkey"), F.sha2(F.col("id").cast("string"), 256).alias("c_name"))
    customers.coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "customer.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
        found = reports.s13_delimited_geometry(spark, str(tmp_path))
        assert found.where("k is null").count() == 0 and found.select("k").distinct().count() == 60_000 == found.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_groups_are_whole_and_numbered(spark):
    df = spark.range(2500).select(F.lit(1).alias("g"), "id", (F.col("id") % 180).alias("lng"), (F.col("id") % 90).alias("lat"))
    found = texts.group_links(df, "g", "id", "lng", "lat")
    assert found.columns == ["g", "line", "geometry"]
    assert [(r.g, r.line, r.geometry.count("[") - 1) for r in found.collect()] == [(1, 0, 2500)]


def test_a_stream_is_kept_in_files(spark, sf):
    kept = loading.t04_stream_without_repeats(spark, sf)
    assert kept.inputFiles() and kept.columns == ["event_id", "ts", "event_type"]
    assert kept.count() == kept.select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_shapes_and_lines_of_one_file_are_compared_by_many_tasks(spark):
    one = spark.createDataFrame([(str(k), "s", f"LINESTRING({k} 0,{k} 9)", "A") for k in range(400)], "ref string, street string, geom string, name string").coalesce(1)
    ready = axes.prepared(one)
    assert ready.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and ready.count() == 400
    assert ready._jdf.queryExecution().optimizedPlan().toString().count("_traits(") == 1


def test_overlaps_of_a_report_are_looked_for_once(spark):
    rows = [(k, k, f"POLYGON(({k} 0,{k + 2} 0,{k + 2} 2,{k} 2,{k} 0))") for k in range(4)]
    staged = spark.createDataFrame(rows, "rec long, k int, geom string")
    _, report = layers.process(staged, "geom", layers.LayerConfig(keys=("k",)))
    assert {r.measure: r.value for r in report.collect()}.items() >= {"overlaps": 3, "would_block": 1}.items()
    assert report._jdf.queryExecution().optimizedPlan().toString().count("_shared(") == 1


def test_a_layer_that_meets_itself_is_not_broadcast(spark):
    boxes = spark.range(50).selectExpr("id", "double(id) as minx", "0d as miny", "double(id + 2) as maxx", "1d as maxy")
    found = spatial.overlaps(boxes, "id", 4.0, 0.5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 49


def test_a_key_part_is_named_once(spark):
    """Code for cleaning that stands in a key again and again grows beyond what the JVM compiles."""
    rows = [("a", None), ("", ""), ("|", ""), (None, "x.0"), (" '5' ", "Ã‘u"), ("N/A", "s/n"), ("", "|")]
    df = spark.createDataFrame(rows, "a string, b string")
    one, two = values.composite_key([F.col("a")]), values.composite_key([F.col("a"), F.col("b")])
    assert [tuple(r) for r in df.select(one, two).collect()] == [("a", "a|"), (None, None), ("|", "||"), (None, "|x"), ("5", "5|ñu"), ("n/a", "n/a|s/n"), (None, "||")]
    held = values.composite_key([F.col("a"), F.col("b")], placeholders=True)
    assert [r[0] for r in df.select(held).collect()][-2:] == [None, "||"]
    assert df.select(one.alias("k")).where("k is not null")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 12


def test_exact_pairs_write_what_they_need(spark, sf, monkeypatch):
    seen, write = [], reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df: seen.append(set(df.columns)) or write(df))
    assert reconciling.j03_exact_pairs(spark, sf).count() > 0
    assert seen[0] == {"is_t", "rec", "key", "sig"} and len(seen) == 2


def test_a_comparison_keeps_its_result_alone(spark, sf, monkeypatch):
    """Geometries are written once, not with classes or signatures, and what was written on the way is gone."""
    seen, write = [], reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df: seen.append(write(df)) or seen[-1])
    found = reconcile.items(*reconciling.shaped_sides(spark, sf), reconciling.SHAPED)
    assert "geom" in seen[0].columns and not {"attr", "shape"} & set(seen[0].columns)
    for df in seen[1:4]:
        assert not {"geom", "v0", "content", "t.geom"} & set(df.columns) and "struct" not in dict(df.dtypes).values()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(df.written_path) for df in seen]
    kept = [p for p in paths if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert len(seen) > 6 and len(kept) <= 3
    assert sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in kept) < 400_000
    assert found.count() == reconcile.summary(found).first().n_total


def test_clashing_and_repeated_contents_come_back_once(spark):
    """Repeated contents of the target and clashing keys of the source, with and without geometry."""
    schema = "k string, v string, g string, rec long"
    at = lambda x: f"POINT({x} 0)"
    t = spark.createDataFrame([("a", "x", at(1), r) for r in (1, 2, 3)] + [("b", "x", at(1), 4)], schema)
    s = spark.createDataFrame([("a", "x", at(1), 1), ("a", "x", at(1), 2), ("n", "x", at(1), 3), ("n", "y", at(1), 4), ("n", "y", at(1), 5), ("m", "x", at(1), 6), ("m", "x", at(1), 7), ("q", "x", "LINESTRING(1 1,1 1)", 8)], schema)
    for geometry in (None, "g"):
        found = reconcile.items(t, s, reconcile.ReconcileConfig(keys=("k",), compared=("v",), geometry=geometry))
        got = sorted((r.key, r.type, r.db_rec or 0, r.file_rec or 0, r.n_rows) for r in found.collect())
        last = ("q", "DEGENERATE", 0, 8, 1) if geometry else ("q", "ONLY_IN_SHP", 0, 8, 1)
        assert got == sorted([
            ("a", "MATCH", 1, 1, 1), ("a", "SKIPPED_TWIN", 0, 1, 1), ("a", "DUPLICATE_SUID", 2, 0, 1), ("a", "DUPLICATE_SUID", 3, 0, 1), ("b", "ONLY_IN_DB", 4, 0, 1),
            *[("n", "DUPLICATE_SUID", 0, r, 1) for r in (3, 4, 5)], ("m", "ONLY_IN_SHP", 0, 6, 1), ("m", "SKIPPED_TWIN", 0, 6, 1), last,
        ])
