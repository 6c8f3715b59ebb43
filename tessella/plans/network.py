"""Queries over a street network drawn from parts, what changed between two states of it, and over places in many reference systems.

Section p lies at y = p // 1000 * 10 from x = p % 1000 * 40 on. By p % 10 it stays, runs the other way, moves, is renamed, gets a new
reference, is split (wholly or in part), is merged with the next one, goes, or is new. A third of all sections share street 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import projection
from ..operators import axes
from ..registry import query, table

_P = """(select p_partkey as p, p_partkey % 10 as kind, p_partkey % 1000 * 40 as x, p_partkey // 1000 * 10 as y, 20 + p_size % 10 as len,
  case when p_partkey // 10 % 3 = 0 then 0 else p_partkey // 10 % 50 end as street, p_partkey % 70 = 2 as renamed, p_partkey % 20 = 5 as whole from part) q"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ref, street, geom, name) of the staged and of the current state."""
    p = F.col("p_partkey")
    tens = F.floor(p / 10)
    rows = table(spark, sf_dir, "part").select(p.alias("p"), (p % 10).alias("kind"), (p % 1000 * 40).alias("x"), (F.floor(p / 1000) * 10).cast("double").alias("y"), (20 + F.col("p_size") % 10).alias("len"), F.when(tens % 3 == 0, F.lit(0)).otherwise(tens % 50).cast("string").alias("street"))
    kind, x, y, size = F.col("kind"), F.col("x").cast("double"), F.col("y"), F.col("len").cast("double")

    def line(x1: Column, x2: Column, dy: float = 0.0) -> Column:
        said = [F.concat(a.cast("string"), F.lit(" "), (y + dy).cast("string")) for a in (x1, (x1 + x2) / 2, x2)]
        return F.concat(F.lit("LINESTRING("), F.concat_ws(",", *said), F.lit(")"))

    own, name = F.col("p"), lambda changed: F.when(changed, "B").otherwise("A")
    section = lambda ref, geom, called=F.lit("A"): F.struct(ref.cast("string").alias("ref"), F.col("street"), geom.alias("geom"), called.alias("name"))
    staged = [
        F.when(kind.isin(0, 3), section(own, line(x, x + size), name(kind == 3))), F.when(kind == 1, section(own, line(x + size, x))), F.when(kind == 2, section(own, line(x, x + size, 0.01), name(own % 70 == 2))),
        F.when(kind == 4, section(own + 100000000, line(x, x + size, 0.25))), F.when(kind == 5, section(own + 200000000, line(x, x + 7))),
        F.when(kind == 5, section(own + 300000000, line(x + 7, F.when(own % 20 == 5, x + size).otherwise(x + 12)))), F.when(kind == 6, section(own + 400000000, line(x, x + 60))), F.when(kind == 9, section(own, line(x, x + size))),
    ]
    new = rows.select(F.inline(F.filter(F.array(*staged), lambda s: s.isNotNull())))
    return new, rows.where("kind <> 9").select(F.inline(F.array(section(own, line(x, x + size)))))


def found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return axes.analysed(*sides(spark, sf_dir), ["street", "name"])


_SECTIONS = f"""(select cast(p as varchar) as ref, kind = 9 as is_new, kind = 3 or (kind = 2 and renamed) as attr_changed, kind = 2 as geom_changed from {_P} where kind in (0, 1, 2, 3, 9)
  union all select cast(p + shift as varchar), true, false, false from {_P} join (values (4, 100000000), (5, 200000000), (5, 300000000), (6, 400000000)) s(k, shift) on kind = k)"""
_MERGED = f"(select a.p, a.len as len6, b.len as len7 from {_P[:-1]}a join {_P[:-1]}b on b.p = a.p + 1 where a.kind = 6)"


@query(f"select * from {_SECTIONS}")
def x16_section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each staged section: new, or with other attributes or another shape than its reference has now."""
    return found(spark, sf_dir)["sections"].select("ref", "is_new", "attr_changed", "geom_changed")


@query(f"""select 'split' as change, cast(p as varchar) as ref, cast(p + 200000000 as varchar) || ',' || cast(p + 300000000 as varchar) as refs, 1.0 as coverage from {_P} where kind = 5 and whole
union all select 'merge', cast(p + 400000000 as varchar), array_to_string(list_sort([cast(p as varchar), cast(p + 1 as varchar)]), ','), round((len6 + least(21, len7)) / (len6 + len7), 6)
  from {_MERGED} where len6 + least(21, len7) >= 0.95 * (len6 + len7)
""")
def a18_axis_splits_and_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed sections that several new ones cover, and new sections that cover several removed ones, with the share covered."""
    all_ = found(spark, sf_dir)
    share = F.round("coverage", 6).alias("coverage")
    splits = all_["splits"].select(F.lit("split").alias("change"), F.col("old_ref").alias("ref"), F.array_join("new_refs", ",").alias("refs"), share)
    return splits.unionByName(all_["merges"].select(F.lit("merge").alias("change"), F.col("new_ref").alias("ref"), F.array_join("old_refs", ",").alias("refs"), share))


_TM = """(select c_custkey, c_custkey % 4 as z, case c_custkey % 4 when 0 then 32721 when 1 then 31981 when 2 then 32630 else 5382 end as srid, case c_custkey % 4 when 2 then -3.0 else -57.0 end as meridian,
  case c_custkey % 4 when 2 then 0.0 else 1e7 end as north, case c_custkey % 4 when 1 then 298.257222101 else 298.257223563 end as rf,
  case c_custkey % 4 when 2 then -3.0 else -57.0 end + (c_custkey * 37 % 6000 - 3000) / 1000.0 as lon, case c_custkey % 4 when 2 then 1 else -1 end * (10 + c_custkey * 91 % 50000 / 1000.0) as lat from customer)"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, srid, lon, lat): places around the meridians of four systems."""
    k = F.col("c_custkey")
    kind = k % 4
    srid = F.when(kind == 0, 32721).when(kind == 1, 31981).when(kind == 2, 32630).otherwise(5382)
    lon = F.when(kind == 2, -3.0).otherwise(-57.0) + (k * 37 % 6000 - 3000) / 1000.0
    return table(spark, sf_dir, "customer").select(k, srid.alias("srid"), lon.alias("lon"), (F.when(kind == 2, 1).otherwise(-1) * (10 + k * 91 % 50000 / 1000.0)).alias("lat"))


@query(f"""with a as (select *, 1 / rf as f from {_TM}), b as (select *, f / (2 - f) as n, sqrt(f * (2 - f)) as e, radians(lat) as phi, radians(lon - meridian) as lam from a),
c as (select *, 0.9996 * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) as r, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 + 41 * n * n * n * n / 180 as a1, 13 * n * n / 48 - 3 * n * n * n / 5 + 557 * n * n * n * n / 1440 as a2, 61 * n * n * n / 240 - 103 * n * n * n * n / 140 as a3, 49561 * n * n * n * n / 161280 as a4 from b),
d as (select *, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) as eta from c)
select c_custkey, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) as x,
  round(north + r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) as y from d""")
def g06_projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic points in the system that each row names, to the millimetre."""
    p = projection.points_in(F.col("lon"), F.col("lat"), F.lit(4326), F.col("srid"))
    return located(spark, sf_dir).select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"""select c_custkey, '{{"type":"Point","coordinates":[' || case when contains(a, '.') then a else a || '.0' end || ',' || case when contains(b, '.') then b else b || '.0' end || ']}}' as feature from (select c_custkey, cast(round(lon, 7) as varchar) as a, cast(round(lat, 7) as varchar) as b from (select c_custkey, cast(lon as double) as lon, cast(lat as double) as lat from {_TM}))""")
def s03_geojson_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in four systems, as EWKT, as WKT beside its SRID, read back as GeoJSON in degrees."""
    p = projection.points_in(F.col("lon"), F.col("lat"), F.lit(4326), F.col("srid"))
    there = located(spark, sf_dir).select("c_custkey", "srid", p.alias("p"))
    text = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SRID="), F.col("srid").cast("string"), F.lit(";"))).otherwise(""), F.lit("POINT("), F.col("p.x").cast("string"), F.lit(" "), F.col("p.y").cast("string"), F.lit(")"))
    declared = F.when(F.col("c_custkey") % 3 != 0, F.col("srid")).otherwise(4326)
    return there.select("c_custkey", projection.to_geojson_in(text, declared).alias("feature"))


@query("""select 'zone' as kind, 'PROJCS["WGS_1984_UTM_Zone_' || cast(1 + s_suppkey % 60 as varchar) || case when s_suppkey % 2 = 0 then 'N' else 'S' end || '"]' as prj, case when s_suppkey % 2 = 0 then 32600 else 32700 end + 1 + s_suppkey % 60 as code from supplier""")
def f27_projection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of projection texts that suppliers' zones name."""
    k = F.col("s_suppkey")
    prj = F.concat(F.lit('PROJCS["WGS_1984_UTM_Zone_'), (1 + k % 60).cast("string"), F.when(k % 2 == 0, "N").otherwise("S"), F.lit('"]'))
    return table(spark, sf_dir, "supplier").select(F.lit("zone").alias("kind"), prj.alias("prj"), projection.epsg_code(prj).alias("code"))
