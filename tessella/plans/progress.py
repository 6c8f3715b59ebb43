"""Building progress drawn from parts: two sheets, a layer of zones, a history, and central limits; the rebuild and its five reports.

The base tables are SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import progress
from ..registry import query, table
from .carto import _BLOCK, blocks

CLOSED = ("PLANNED",)
_SHEET = """select p_partkey as p, p_size < 25 as first_sheet, concat(' ', cast(p_partkey % 20 as string), ' ') as building, cast(10 + cast(floor(p_partkey / 20.0) as int) % 20 as string) as cable,
  case when p_partkey % 97 = 0 then null when p_partkey % 50 = 0 then 'DO' else concat('0', cast(cast(floor(p_partkey / 400.0) as int) % 3 as string)) end as zone, p_brand as central,
  concat('h', cast(p_partkey % 4 as string)) as hub, concat('l', cast(p_partkey % 3 as string)) as label from {part}"""
_ZONES = f"""select min(p) as id, trim(building) as building, concat('C0', cable, 'Z', zone) as code, case when min(p) % 9 = 0 then 'PLANNED' else 'BUILT' end as status from ({_SHEET}) s where zone <> 'DO' and p % 3 <> 0 group by trim(building), cable, zone"""
_STATE = "case {0} % 5 when 0 then 'EJECUTADA' when 1 then 'EJECUTADA SIN PLANOSALCOM' when 2 then 'EN TRABAJO' when 3 then 'PLAN 2017' else 'Ejecutada' end"
_NOW = f"select building, code as cable, status as zone, case when id % 11 <> 0 then {_STATE.format('id')} end as state from ({_ZONES}) z where id % 13 <> 0"
_THEN = f"select building, code as cable, status as zone, {_STATE.format('(id * 7 + 2)')} as state, d as loaded from ({_ZONES}) z cross join (select 1 as d union all select 2) t where not (d = 2 and id % 17 = 0)"
_duck = lambda sql: sql.replace("{part}", "part")


def base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("cross join (select 1 as d union all select 2) t", "lateral view explode(array(1, 2)) t as d"), part=table(spark, sf_dir, "part"))


def sheets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = base(spark, sf_dir, _SHEET)
    return [rows.where("first_sheet"), rows.where("not first_sheet")]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with a box of 8 by 8 each."""
    x, y = F.col("id") * 37 % 1000, F.col("id") * 91 % 160
    said = [F.concat((x + a).cast("string"), F.lit(" "), (y + b).cast("string")) for a, b in ((0, 0), (8, 0), (8, 8), (0, 8), (0, 0))]
    return base(spark, sf_dir, _ZONES).withColumn("geom", F.concat(F.lit("POLYGON(("), F.concat_ws(",", *said), F.lit("))")))


_KEYS = f"""s as ({_duck(_SHEET)}), z as ({_duck(_ZONES)}), o as (select * from z where status <> 'PLANNED'),
u as (select distinct building, cable, zone, hub, label, first_sheet from s where zone not in ('DO', 'Primario', 'PRIMARIO'))"""


@query(f"""with {_KEYS} select distinct central, '0' || trim(s.cable) as cable, s.zone, hub, s.building, label, o.id as zone_id from s join o on trim(s.building) || '|C0' || trim(s.cable) || '|Z' || trim(s.zone) = o.building || '|' || replace(o.code, 'Z', '|Z')""")
def x07_rebuilt_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both sheets with the zone that their key names."""
    return progress.rebuilt(sheets(spark, sf_dir), zones(spark, sf_dir), ["central", "cable", "zone", "hub", "building", "label"], CLOSED).drop("geom")


@query(f"""with {_KEYS}, d as (select building, cable, zone, first_sheet from s where zone not in ('DO', 'Primario', 'PRIMARIO') group by all having count(*) > 1)
select s.p, case when s.first_sheet then 0 else 1 end as sheet, s.building, s.cable, s.zone from s join d on s.building = d.building and s.cable = d.cable and s.zone = d.zone and s.first_sheet = d.first_sheet""")
def x07_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.duplicates(sheets(spark, sf_dir)).select("p", "sheet", "building", "cable", "zone")


@query(f"""with av as ({_duck(_NOW)}), h as ({_duck(_THEN)}), b as (select * from h where loaded = (select max(loaded) from h))
select b.building, b.cable, b.zone, b.state as was, av.state as is_now, b.loaded from av right join b on av.cable = b.cable and av.zone = b.zone and av.building = b.building
where case when upper(av.state) = upper(b.state) then 'OK' else 'ERROR' end = 'ERROR' and (upper(b.state) = 'EJECUTADA' or upper(b.state) = 'EJECUTADA SIN PLANOSALCOM' and (av.state <> 'EJECUTADA' and av.state <> 'EJECUTADA SIN PLANOSALCOM')
  or upper(b.state) = 'EN TRABAJO' and upper(av.state) not in ('EJECUTADA', 'EJECUTADA SIN PLANOSALCOM', 'EN TRABAJO') or upper(b.state) = 'PLAN 2017' and upper(av.state) not in ('PLAN 2017', 'EJECUTADA', 'EJECUTADA SIN PLANOSALCOM', 'EN TRABAJO'))""")
def x07_state_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose state fell behind the one of the latest load."""
    return progress.state_errors(base(spark, sf_dir, _NOW), base(spark, sf_dir, _THEN)).select("building", "cable", "zone", "was", "is_now", "loaded")


@query(f"""with {_KEYS}, m as (select u.building || '|' || u.cable || '|' || u.zone as k from u join o on trim(u.building) || '|C0' || trim(u.cable) || '|Z' || trim(u.zone) = o.building || '|' || replace(o.code, 'Z', '|Z'))
select building, cable, zone, hub, label from u where building || '|' || cable || '|' || zone not in (select k from m)""")
def x07_in_sheets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.in_sheets_only(sheets(spark, sf_dir), zones(spark, sf_dir), CLOSED).select("building", "cable", "zone", "hub", "label")


@query(f"""with {_KEYS}, k as (select o.*, o.building || '|' || substr(o.code, 1, 4) || '|' || substr(o.code, 5, 3) as k from o), m as (select k from k join u on trim(u.building) || '|C0' || trim(u.cable) || '|Z' || trim(u.zone) = k where p_odd(u.hub))
select id, building, code from k where k not in (select k from m)""".replace("p_odd(u.hub)", "u.hub <> 'h1'"))
def x07_in_zones_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that the sheets, here without the rows of one hub, don't name."""
    return progress.in_zones_only([s.where("hub <> 'h1'") for s in sheets(spark, sf_dir)], zones(spark, sf_dir), CLOSED).select("id", "building", "code")


@query(f"""with z as ({_duck(_ZONES)}), b as (select id, id * 37 % 1000 as minx, id * 91 % 160 as miny from z),
s as (select b.id, sum(greatest(0, least(b.minx + 8, c.maxx) - greatest(b.minx, c.minx)) * greatest(0, least(b.miny + 8, c.maxy) - greatest(b.miny, c.miny))) filter (c.id is not null) / 64 as share from b left join {_BLOCK} c on b.minx < c.maxx and c.minx < b.minx + 8 and b.miny < c.maxy and c.miny < b.miny + 8 group by b.id)
select id, round(coalesce(share, 0), 9) as share from s where coalesce(share, 0) < 0.9""")
def x07_outside_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of which a tenth or more lies outside the central limits."""
    limits = blocks(spark, sf_dir)
    corner = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" "), F.col(b).cast("string"))
    ring = F.concat_ws(",", corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    limits = limits.select("id", F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("geom"))
    return progress.outside(zones(spark, sf_dir).select("id", "geom"), limits, 40.0).select("id", F.round("share", 9).alias("share"))
