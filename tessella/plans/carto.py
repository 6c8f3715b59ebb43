"""Spatial queries over boxes drawn from parts and suppliers: overlaps, cover, replacement, receivers, views.

The plane grows with the tables, in strips of 1000 by 1000 with 625 suppliers, 12,500 parts and 9,375 customers each.
All coordinates are whole numbers, so areas are exact on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import spatial
from ..registry import query, table

_PARCEL = """(select p_partkey as id, cast(p_partkey * 37 % 1000 as double) as minx, cast(p_partkey * 91 % 1000 + p_partkey // 12500 * 1000 as double) as miny,
  cast(p_partkey * 37 % 1000 + 5 + p_size % 20 as double) as maxx, cast(p_partkey * 91 % 1000 + p_partkey // 12500 * 1000 + 5 + p_size % 13 as double) as maxy from part)"""
_BLOCK = """(select s_suppkey as id, cast(s_suppkey % 25 * 40 as double) as minx, cast(s_suppkey // 25 * 40 as double) as miny,
  cast(s_suppkey % 25 * 40 + 30 as double) as maxx, cast(s_suppkey // 25 * 40 + 38 as double) as maxy from supplier)"""
_POINT = "(select c_custkey as pid, cast(c_custkey * 17 % 1000 as double) as x, cast(c_custkey * 53 % 1000 + c_custkey // 9375 * 1000 as double) as y from customer)"
CELL = 40.0


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey") * 37 % 1000, F.col("p_partkey") * 91 % 1000 + F.floor(F.col("p_partkey") / 12500) * 1000
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.cast("double").alias("minx"), y.cast("double").alias("miny"), (x + 5 + F.col("p_size") % 20).cast("double").alias("maxx"), (y + 5 + F.col("p_size") % 13).cast("double").alias("maxy"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint boxes on a lattice."""
    x, y = F.col("s_suppkey") % 25 * 40, F.floor(F.col("s_suppkey") / 25) * 40
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), x.cast("double").alias("minx"), y.cast("double").alias("miny"), (x + 30).cast("double").alias("maxx"), (y + 38).cast("double").alias("maxy"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 17 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 53 % 1000 + F.floor(F.col("c_custkey") / 9375) * 1000).cast("double").alias("y"))


_SHARED = "greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"
_MEET = "a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy"


@query(f"select a.id as a_id, b.id as b_id, {_SHARED} as shared from {_PARCEL} a join {_PARCEL} b on a.id < b.id and {_MEET} where {_SHARED} > 1")
def j14_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlaps(parcels(spark, sf_dir), "id", CELL, 1.0).select("a_id", "b_id", "shared")


@query(f"select a.id as a_id, b.id as b_id, {_SHARED} as shared from {_PARCEL} a join {_PARCEL} b on a.id < b.id and {_MEET} where {_SHARED} > 1 order by shared desc, a_id, b_id limit 20")
def o03_overlap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j14_overlaps(spark, sf_dir).orderBy(F.desc("shared"), "a_id", "b_id").limit(20)


_SHARE = f"select a.id, coalesce(sum(case when b.id is not null then {_SHARED} end), 0) / ((any_value(a.maxx) - any_value(a.minx)) * (any_value(a.maxy) - any_value(a.miny))) as share from {_PARCEL} a left join {_BLOCK} b on {_MEET} group by a.id"


@query(f"select id, round(share, 9) as share from ({_SHARE}) where share < 0.9")
def j16_outside_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which less than 90 % lies in the cover."""
    return spatial.cover_share(parcels(spark, sf_dir), "id", blocks(spark, sf_dir), CELL).where("share < 0.9").select("id", F.round("share", 9).alias("share"))


@query(f"""with p as (select a.id, {_SHARED} / ((a.maxx - a.minx) * (a.maxy - a.miny)) as share from {_PARCEL} a join {_BLOCK} b on {_MEET}),
s as (select id, count(*) filter (share >= 0.05) as n, max(share) as best, coalesce(sum(share) filter (share >= 0.05), 0) as t from p group by id)
select a.id, case when best >= 0.9 then 'REPLACED_ONE' when n >= 2 and t >= 0.9 then 'SUBDIVIDED' when t >= 0.5 then 'PARTIAL' else 'ORPHAN' end as class, cast(coalesce(n, 0) as bigint) as n_parts from {_PARCEL} a left join s using (id)""")
def a19_replacement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.replacement_classes(parcels(spark, sf_dir), "id", blocks(spark, sf_dir), CELL)


@query(f"select pid, count(id) as n_receivers, min(id) as receiver from {_POINT} left join {_BLOCK} on x between minx and maxx and y between miny and maxy group by pid")
def j19_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.containment(points(spark, sf_dir), "pid", blocks(spark, sf_dir), "id", CELL)


@query(f"""with d as (select pid, id, power(greatest(0, minx - x, x - maxx), 2) + power(greatest(0, miny - y, y - maxy), 2) as d2, (maxx - minx) * (maxy - miny) as area from {_POINT} cross join {_BLOCK})
select pid, id as receiver, d2 from (select *, row_number() over (partition by pid order by d2, area desc, id) as r from d where d2 <= 1600) where r = 1""")
def j18_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(points(spark, sf_dir), "pid", blocks(spark, sf_dir), "id", CELL)


@query(f"select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from {_PARCEL}")
def a25_collection_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bounds(parcels(spark, sf_dir))


@query(f"select id from {_PARCEL} where minx <= 300 and maxx >= 200 and miny <= 400 and maxy >= 350")
def g17_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_view(parcels(spark, sf_dir), (200.0, 350.0, 300.0, 400.0)).select("id")


@query(f"""select id, b_id, cast(rank as integer) as rank from (select a.id, b.id as b_id, row_number() over (partition by a.id order by {_SHARED} desc, b.id) as rank from {_PARCEL} a join {_BLOCK} b on {_MEET}) where rank <= 5""")
def w09_top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.box_join(parcels(spark, sf_dir), blocks(spark, sf_dir), CELL)
    return spatial.top_parts(pairs, "a_id", [F.desc("shared"), "b_id"], 5).select(F.col("a_id").alias("id"), "b_id", "rank")
