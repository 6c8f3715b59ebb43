"""Queries over polygon layers drawn from parts: repair, union by key, layer processing, subdivision.

All rings are boxes with whole-number corners, alone, as holes, or crossing each other, so SQL can count a region's unit cells: a
cell is inside where an odd number of a row's rings holds it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import layers, upserts, versions
from ..operators.staging import settled, shared_folder
from ..registry import query, table
from ..sources import shape_ranges

#: Rings (rec, k, brand, kind, x1, y1, x2, y2): kind 4 has a hole, 5 a ring across the first one, 7 no area; some have no geometry or no key.
_BASE = """(select p_partkey as rec, p_brand as brand, p_partkey % 8 as kind, p_partkey % 41 = 0 as bare, p_partkey * 37 % 1000 as x, p_partkey * 91 % 1000 + p_partkey // 12500 * 1000 as y, 6 + p_size % 20 as w, 6 + p_size % 13 as h,
  case when p_partkey % 29 <> 0 then p_partkey * 37 % 1000 // 40 + p_partkey // 12500 * 1000 end as k1, p_partkey * 91 % 1000 // 40 as k2 from part)"""
_CELLS = f"""
base as (select *, case when k1 is null then rec end as own from {_BASE}),
rings as (select rec, k1, k2, own, x as x1, y as y1, x + w as x2, y + h as y2 from base where not bare and kind <> 7
  union all select rec, k1, k2, own, x + 1, y + 1, x + w - 2, y + h - 2 from base where not bare and kind = 4
  union all select rec, k1, k2, own, x + 2, y + 2, x + w + 3, y + h + 3 from base where not bare and kind = 5),
cols as (select *, unnest(range(x1, x2)) as cx from rings),
spots as (select rec, k1, k2, own, cx, unnest(range(y1, y2)) as cy from cols),
cells as (select rec, k1, k2, own, cx, cy from spots group by all having count(*) % 2 = 1)
"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, k1, k2, brand, geom): the same rows with their rings as WKT."""
    p = F.col("p_partkey")
    x, y = p * 37 % 1000, p * 91 % 1000 + F.floor(p / 12500) * 1000
    w, h = 6 + F.col("p_size") % 20, 6 + F.col("p_size") % 13

    def ring(x1: Column, y1: Column, x2: Column, y2: Column, back: Column | None = None) -> Column:
        corner = lambda a, b: F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
        corners = [corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1)]
        said = lambda c: F.concat(F.lit("("), F.concat_ws(",", *c), F.lit(")"))
        return said(corners) if back is None else F.when(back, said(corners[::-1])).otherwise(said(corners))

    kind = p % 8
    rings = F.concat_ws(",", ring(x, y, x + w, y + h, kind == 6), F.when(kind == 4, ring(x + 1, y + 1, x + w - 2, y + h - 2)), F.when(kind == 5, ring(x + 2, y + 2, x + w + 3, y + h + 3)))
    flat = F.concat(F.lit("("), F.concat_ws(",", *[F.concat(a.cast("string"), F.lit(" "), y.cast("string")) for a in (x, x + w, x)]), F.lit(")"))
    geom = F.when(p % 41 != 0, F.concat(F.lit("POLYGON("), F.when(kind == 7, flat).otherwise(rings), F.lit(")")))
    k1 = F.when(p % 29 != 0, F.floor(x / 40) + F.floor(p / 12500) * 1000)
    return table(spark, sf_dir, "part").select(p.cast("long").alias("rec"), k1.alias("k1"), F.floor(p * 91 % 1000 / 40).alias("k2"), F.col("p_brand").alias("brand"), geom.alias("geom"))


_BORDER = """select {0}, count(*) as sides from (select {0}, cx, cy, unnest([[1, 0], [-1, 0], [0, 1], [0, -1]]) as d from {1}) a
  where not exists (select 1 from {1} b where {2} and b.cx = a.cx + a.d[1] and b.cy = a.cy + a.d[2]) group by {0}"""


@query(f"""with {_CELLS}, u as (select distinct k1, k2, cx, cy from cells where k1 is not null),
f as (select k1, k2, min(b.rec) as rec, arg_min_null(brand, b.rec) as brand, count(*) as n_rows from base b where k1 is not null and not bare and kind <> 7 group by k1, k2),
s as ({_BORDER.format("k1, k2", "u", "b.k1 = a.k1 and b.k2 = a.k2")})
select cast(f.k1 as bigint) as k1, cast(f.k2 as bigint) as k2, cast(rec as bigint) as rec, brand, n_rows, cast(count(*) as double) as area, cast(any_value(sides) as double) as border
from f join u on f.k1 = u.k1 and f.k2 = u.k2 join s on f.k1 = s.k1 and f.k2 = s.k2 group by all""")
def a06_parcel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels united by key, with area and length of the border."""
    out = layers.union_by_key(parcels(spark, sf_dir), "geom", ["k1", "k2"], ["brand"])
    return out.select("k1", "k2", "rec", "brand", "n_rows", "area", layers.border(F.col("geom")).alias("border"))


@query(f"""with base as (select *, kind in (5, 7) as bad from {_BASE}), u as (select k1, k2, count(*) as n, count(*) filter (bad) as bad from base where k1 is not null and not bare and kind <> 7 group by all)
select count(*) as n_rows, count(*) filter (k1 is null) as n_without_key, count(*) filter (bare) as n_without_geometry, count(*) filter (not bare and kind = 7) as n_empty, (select count(*) from u) as n_keys,
  (select cast(sum(bad) as bigint) from u) as n_repaired, (select cast(coalesce(sum(bad) filter (n = 1), 0) as bigint) from u) as n_invalid_alone, (select cast(coalesce(sum(bad) filter (n > 1), 0) as bigint) from u) as n_invalid_in_union from base""")
def a07_geometry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.union_report(parcels(spark, sf_dir), "geom", ["k1", "k2"])


CFG = layers.LayerConfig(keys=("k1", "k2"), compared=("brand",), single_part=True)
_UNIFIED = f"""{_CELLS},
g as (select k1, k2, own, min(rec) as rec, arg_min_null(brand, rec) as brand, count(*) as n_rows from base group by k1, k2, own),
odd as (select k1, k2, own, cx, cy from cells group by all having count(*) % 2 = 1),
xor as (select g.rec, cx, cy from odd join g on g.k1 is not distinct from odd.k1 and g.k2 = odd.k2 and g.own is not distinct from odd.own)
"""


@query(f"""with {_UNIFIED} select cast(k1 as bigint) as k1, cast(k2 as bigint) as k2, cast(g.rec as bigint) as rec, brand, n_rows, cast(nullif(count(xor.rec), 0) as double) as area from g left join xor on g.rec = xor.rec group by all""")
def x02_processed_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged layer after repair, unification by key and repair of the unified rows."""
    return layers.process(parcels(spark, sf_dir), "geom", CFG)[0].select("k1", "k2", "rec", "brand", "n_rows", "area")


_PAIRS = "select a.rec as a_id, b.rec as b_id, cast(count(*) as double) as area from xor a join xor b on a.cx = b.cx and a.cy = b.cy and a.rec < b.rec group by all having count(*) > 1"


@query(f"with {_UNIFIED} select cast(a_id as bigint) as a_id, cast(b_id as bigint) as b_id, area from ({_PAIRS})")
def x02_layer_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the processed layer that share more than a unit of area."""
    layer, _ = layers.process(parcels(spark, sf_dir), "geom", CFG)
    return layers.overlaps(layer.where("geom is not null"), "rec", CFG.least_area, CFG.cell)


@query(f"""with {_UNIFIED},
near as (select c.rec, k1, k2, cx + d[1] as cx, cy + d[2] as cy from (select *, unnest([[0, 0], [1, 0], [0, 1], [-1, 0], [0, -1]]) as d from cells where k1 is not null) c),
hit as (select distinct a.k1, a.k2 from near a join cells b on a.k1 = b.k1 and a.k2 = b.k2 and a.cx = b.cx and a.cy = b.cy and a.rec < b.rec),
facts as (select 'invalid_before' as measure, count(*) as value from base where not bare and kind in (5, 7)
  union all select 'repaired', (select count(*) from base where not bare and kind in (5, 7)) + (select count(*) from hit)
  union all select 'empty_after_repair', count(*) from base where not bare and kind = 7
  union all select 'inserted_invalid', 0
  union all select 'inserted_rows', count(*) from g
  union all select 'groups', count(*) from g where n_rows > 1
  union all select 'rows_merged', cast(sum(n_rows - 1) as bigint) from g
  union all select 'null_key_rows', count(*) from base where k1 is null
  union all select 'overlaps', count(*) from ({_PAIRS})
  union all select 'would_block', case when (select count(*) from ({_PAIRS})) > 0 then 1 else 0 end)
select measure, cast(value as bigint) as value from facts""")
def x02_layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the processing of a layer did and found. (The number of multi-part rows is held by tests: cells don't tell parts that
    touch at a corner.)"""
    return layers.process(parcels(spark, sf_dir), "geom", CFG)[1].where("measure <> 'incompatible'")


_SKYLINE = """(select c_nationkey as nation, c_custkey // 2000 as block, row_number() over (partition by c_nationkey, c_custkey // 2000 order by c_custkey) - 1 as i, 1 + c_custkey % 7 + c_custkey * c_custkey % 5 as h from customer)"""
MOST_VERTICES = 24


def skylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, block, geom): a polygon of columns side by side for the customers of a nation in each block of 2000 keys."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(c / 2000).alias("block"), F.struct(c.alias("c"), (1 + c % 7 + c * c % 5).alias("h")).alias("x"))
    heights = rows.groupBy("nation", "block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.h.cast("string")).alias("h"))  # at most 2000 a group
    tops = F.array_join(F.transform("h", lambda h, i: F.concat(i.cast("string"), F.lit(" "), h, F.lit(","), (i + 1).cast("string"), F.lit(" "), h)), ",")
    return heights.select("nation", "block", F.concat(F.lit("POLYGON((0 0,"), tops, F.lit(","), F.size("h").cast("string"), F.lit(" 0,0 0))")).alias("geom"))


def pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    whole = layers.examined(skylines(spark, sf_dir), "geom")
    return whole, layers.subdivided(whole, ["nation", "block"], MOST_VERTICES)


@query(f"select nation, block, cast(sum(h) as double) as area, true as fits, 2 * count(*) + 3 > 24 as cut from {_SKYLINE} group by all")
def x09_subdivided_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons in pieces of few vertices: the pieces' area is the whole's, and no piece has too many vertices."""
    _, found = pieces(spark, sf_dir)
    return found.groupBy("nation", "block").agg(F.round(F.sum("area"), 6).alias("area"), (F.max("n_vertices") <= MOST_VERTICES).alias("fits"), (F.count("*") > 1).alias("cut"))


@query(f"""with w as (select nation, block, sum(h) as area from {_SKYLINE} group by all)
select 'whole' as layer, count(*) as n_old, cast(sum(area) as double) as area_old, cast(sum(area) as double) as area_new, true as passes from w
union all select 'lost', count(*), cast(sum(area) as double), cast(sum(area) filter (nation <> 3) as double), false from w""")
def k14_gated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate before a swap lets all pieces pass, and refuses them where the pieces of a nation are lost."""
    whole, found = pieces(spark, sf_dir)
    old, found = settled(whole.select("area", "n_vertices")), settled(found)

    def gate(name: str, new: DataFrame) -> DataFrame:
        out = upserts.gates(old, new, "area", "n_vertices", MOST_VERTICES)
        return out.select(F.lit(name).alias("layer"), "n_old", F.round("area_old", 6).alias("area_old"), F.round("area_new", 6).alias("area_new"), "passes")

    return gate("whole", found).unionByName(gate("lost", found.where("nation <> 3")))


@query(f"""with {_CELLS} select cast(rec as bigint) as rec, cast(count(*) as double) as area, cast((rec % 8 = 4)::int as bigint) as n_holes from cells group by rec""")
def s23_record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as records of a shapefile, read back: rings measured, holes put into their shells by winding numbers."""
    whole = layers.examined(parcels(spark, sf_dir), "geom").where("geom is not null").select("rec", layers.shape_record(F.col("geom")).alias("content"))
    return shape_ranges.record_parts(whole, "content").groupBy("rec").agg(F.sum("area").alias("area"), F.sum("n_holes").alias("n_holes"))


@query(f"""with {_CELLS}, u as (select distinct k1, k2, cx, cy from cells where k1 is not null), t as (select k1, k2, count(*) as area from u group by all)
select 1 as n_refused, 2 as n_commits, count(*) as n_rows, cast(sum(area) as double) as area, true as reverted from t""")
def x10_parcel_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels united by key replace a table as a checked version. A load that lost the western half is refused, and the table keeps
    its rows; a load of the same rows goes through, and the first version comes back when it is asked for."""
    table_ = versions.Versions(spark, shared_folder(spark))
    united = settled(layers.union_by_key(parcels(spark, sf_dir), "geom", ["k1", "k2"], ["brand"]))
    drift = versions.facts_gate(lambda old, new: upserts.gates(old, new, "area", "n_vertices", 1 << 20))
    gates = [versions.unique_gate(["k1", "k2"]), versions.ratio_gate(), drift]
    first = table_.replace(united, gates)
    refused = 0
    try:
        table_.replace(united.where("minx >= 500"), gates)
    except versions.Refused:
        refused = 1
    second = table_.replace(united.repartition(3), gates)
    commits = len(table_.commits())
    table_.revert(first)
    back = first != second and table_.commits()[-1][1] == first
    now = table_.read()
    return now.agg(F.lit(refused).alias("n_refused"), F.lit(commits).alias("n_commits"), F.count("*").alias("n_rows"), F.sum("area").alias("area"), F.lit(back).alias("reverted"))


@query(f"""with {_UNIFIED} select 'loaded' as state, count(*) as n_rows, cast(sum(a) as double) as area from (select g.rec, nullif(count(xor.rec), 0) as a from g left join xor on g.rec = xor.rec group by g.rec)""")
def x03_layer_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged layer, processed, replaces an empty table whole: stage, repair, unify, overlap report, count check, commit."""
    target = versions.Versions(spark, shared_folder(spark))
    layer, report = layers.process(parcels(spark, sf_dir), "geom", replace(CFG, block=False))
    facts = {r.measure: r.value for r in report.collect()}

    def counted(_: DataFrame | None, staged: DataFrame) -> str | None:
        n = staged.count()
        return None if n == facts["inserted_rows"] and not facts["would_block"] else f"{n} rows, {facts}"

    target.replace(layer.drop("collided"), [counted])
    return target.read().agg(F.lit("loaded").alias("state"), F.count("*").alias("n_rows"), F.sum("area").alias("area"))


@query(f"""select 'swapped' as state, count(*) as n_layers, cast(sum(area) as double) as area from (select sum(h) as area from {_SKYLINE} group by nation, block)""")
def x09_coverage_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons as shape records, read in parts, repaired, cut into pieces, and swapped in behind the gates: no area lost, no piece too
    large, none invalid."""
    whole = layers.examined(skylines(spark, sf_dir), "geom").select("nation", "block", layers.shape_record(F.col("geom")).alias("content"), "area")
    parts = shape_ranges.record_parts(whole.drop("area"), "content").select("nation", "block", "part", F.hex("geom").alias("geom"))
    cut = settled(layers.subdivided(layers.examined(parts, "geom"), ["nation", "block", "part"], MOST_VERTICES))
    target = versions.Versions(spark, shared_folder(spark))
    before = settled(whole.select("area", F.lit(0).alias("n_vertices")))
    target.replace(cut, [versions.facts_gate(lambda old, new: upserts.gates(old, new, "area", "n_vertices", MOST_VERTICES), before)])
    return target.read().agg(F.lit("swapped").alias("state"), F.countDistinct("nation", "block").alias("n_layers"), F.round(F.sum("area"), 6).alias("area"))
