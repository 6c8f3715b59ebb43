"""Change plans, guards and exports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import numbering, texts, upserts
from ..registry import query, table

_STORED = """(select c_custkey as k, case when c_custkey % 10 = 0 then null else c_nationkey end as n, c_mktsegment as seg, c_acctbal as bal from customer where c_custkey % 7 <> 3)"""
_WANTED = """(select c_custkey as k, case when c_custkey % 10 = 0 then null else c_nationkey end as n, case when c_custkey % 5 = 0 then 'NEW' else c_mktsegment end as seg,
  case when c_custkey % 6 = 0 then null else c_acctbal end as bal from customer where c_custkey % 7 <> 4)"""


def stored_and_wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    n = F.when(k % 10 != 0, F.col("c_nationkey")).alias("n")
    stored = c.where("c_custkey % 7 <> 3").select(k.alias("k"), n, F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    wanted = c.where("c_custkey % 7 <> 4").select(k.alias("k"), n, F.when(k % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(k % 6 != 0, F.col("c_acctbal")).alias("bal"))
    return stored, wanted


_PLAN = f"""with p as (select coalesce(s.k, w.k) as k, coalesce(s.n, w.n) as n, case when s.k is null then 'INSERT' when w.k is null then 'DELETE' else 'UPDATE' end as action,
  w.seg as seg, w.bal as bal, s.seg as old_seg, s.bal as old_bal
  from {_STORED} s full join {_WANTED} w on s.k is not distinct from w.k and s.n is not distinct from w.n
  where s.k is null or w.k is null or s.seg is distinct from w.seg or s.bal is distinct from w.bal)"""


def flat(plan: DataFrame) -> DataFrame:
    return plan.select("k", "n", "action", F.col("new.seg").alias("seg"), F.col("new.bal").alias("bal"), F.col("old.seg").alias("old_seg"), F.col("old.bal").alias("old_bal"))


@query(_PLAN + "select * from p")
def k17_upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(upserts.upsert_plan(*stored_and_wanted(spark, sf_dir), ["k", "n"], ["seg", "bal"]))


@query(_PLAN + "select k, n, case action when 'INSERT' then 'DELETE' when 'DELETE' then 'INSERT' else action end as action, old_seg as seg, old_bal as bal, seg as old_seg, bal as old_bal from p")
def k17_revert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(upserts.revert_plan(upserts.upsert_plan(*stored_and_wanted(spark, sf_dir), ["k", "n"], ["seg", "bal"])))


@query(f"select * from {_WANTED}")
def k17_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after its plan is the wanted one."""
    stored, wanted = stored_and_wanted(spark, sf_dir)
    return upserts.apply_plan(stored, upserts.upsert_plan(stored, wanted, ["k", "n"], ["seg", "bal"]), ["k", "n"], ["seg", "bal"])


@query(f"select * from {_STORED}")
def k07_replace_and_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage, replace, and take it back: the plan and then its inverse leave the table as it was."""
    stored, wanted = stored_and_wanted(spark, sf_dir)
    plan = upserts.upsert_plan(stored, wanted, ["k", "n"], ["seg", "bal"])
    return upserts.apply_plan(upserts.apply_plan(stored, plan, ["k", "n"], ["seg", "bal"]), upserts.revert_plan(plan), ["k", "n"], ["seg", "bal"])


@query(f"select s.k, s.seg as old_seg, w.seg from {_STORED} s join {_WANTED} w on s.k = w.k and s.n is not distinct from w.n")
def j12_null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, wanted = stored_and_wanted(spark, sf_dir)
    s, w = stored.alias("s"), wanted.alias("w")
    on = upserts.null_safe([F.col("s.k"), F.col("s.n")], [F.col("w.k"), F.col("w.n")])
    return s.join(w, on).select("s.k", F.col("s.seg").alias("old_seg"), "w.seg")


@query("""with r as (select c_custkey from customer where c_acctbal < 0)
select 'lineitem' as "table", cast(1 as integer) as position, count(*) as n_rows from lineitem join orders on l_orderkey = o_orderkey where o_custkey in (select c_custkey from r)
union all select 'orders', 2, count(*) from orders where o_custkey in (select c_custkey from r) union all select 'roots', 3, count(*) from r""")
def k18_cascaded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    return upserts.cascade(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", [("lineitem", lines, "o_custkey"), ("orders", orders, "o_custkey")])


@query("""select count(*) as n_old, count(*) as n_new, cast(max(p_size) as bigint) as most_vertices, cast(count(*) filter (p_partkey % 500 = 0) as bigint) as n_invalid,
  count(*) filter (p_partkey % 500 = 0) = 0 as passes from part""")
def k14_gated_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("vertices"), F.col("p_retailprice").alias("area"))
    new = part.withColumn("area", F.when(F.col("p_partkey") % 500 != 0, F.col("area")))
    return upserts.gates(part, new, "area", "vertices", drift=1.0).select("n_old", "n_new", "most_vertices", "n_invalid", "passes")


@query("""select c_mktsegment, n_total, c_custkey from (select c_mktsegment, c_custkey, count(*) over (partition by c_mktsegment) as n_total,
  row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as nth from customer) where nth <= 25""")
def k05_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.preview(table(spark, sf_dir, "customer"), "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"]).select("c_mktsegment", "n_total", "c_custkey")


@query("""select 'events' as step, cast(count(*) filter (value >= 0.5) as bigint) as n_loaded, cast(count(*) filter (value < 0.5) as bigint) as n_rejected, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started_at,
  case when count(*) filter (value < 0.5) > 0 then 'PARTIAL' else 'DONE' end as state from events""")
def k26_load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = upserts.audit(table(spark, sf_dir, "events"), "events", F.col("ts"), F.col("value") < 0.5)
    return out.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("""select event_id, cast(nullif(case when event_id % 3 = 0 then '' else cast(user_id as varchar) end, '') as bigint) as user_id, case when event_id % 4 = 0 then '' else event_type end as kind,
  cast(nullif(case when event_id % 5 = 0 then '' else cast(cast(ts as date) as varchar) end, '') as date) as day from events""")
def k10_staged_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    staged = e.select(i, F.when(i % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_id"), F.when(i % 4 == 0, "").otherwise(F.col("event_type")).alias("kind"), F.when(i % 5 == 0, "").otherwise(F.to_date("ts").cast("string")).alias("day"))
    kinds = {"user_id": "bigint", "kind": "string", "day": "date"}
    return staged.select("event_id", *[texts.staged_cast(F.col(c), k).alias(c) for c, k in kinds.items()])


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'caf' || chr(233) || '?' else p_name end || ';' || p_brand || ';' || case when p_partkey % 4 = 0 then '' else cast(p_size as varchar) end as line from part""")
def k21_latin1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "café‰").otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("size"))
    return rows.select("p_partkey", texts.latin1_line(["name", "p_brand", "size"]).alias("line"))


@query("""select c_custkey, case when c_custkey % 9 <> 0 then '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || cast(c_custkey % 180 as varchar) || '.5,' || cast(c_custkey % 90 as varchar) || '.25]},"properties":{"c_mktsegment":"' || c_mktsegment || '"}}' end as feature from customer""")
def k22_geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lng, lat = k % 180 + F.lit(0.5), F.when(k % 9 != 0, k % 90 + F.lit(0.25))
    return table(spark, sf_dir, "customer").select("c_custkey", texts.point_geojson(lng, lat, ["c_mktsegment"]).alias("feature"))


@query("""select o_custkey, cast(0 as bigint) as line, '{"type":"LineString","coordinates":[' || string_agg('[' || cast(o_orderkey % 180 as varchar) || ',' || cast(o_orderkey % 90 as varchar) || ']', ',' order by o_orderkey) || ']}' as geometry
  from orders where o_orderkey % 9 <> 0 group by o_custkey having count(*) > 1""")
def k22_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", k, (k % 180).alias("lng"), F.when(k % 9 != 0, k % 90).alias("lat"))
    return texts.group_links(rows, "o_custkey", "o_orderkey", "lng", "lat")


@query("""select id, change, row_number() over (order by case when l_linenumber <> 4 then abs(change) end desc nulls last, id, n) as rank from (select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as id,
  l_linenumber, case when l_linenumber <> 4 then round(l_quantity - 25, 2) end as change, row_number() over (partition by (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey order by l_quantity) as n from lineitem)""")
def k24_pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes, the largest first and unknown ones last; the rank stands for the order of the file."""
    change = F.when(F.col("l_linenumber") != 4, F.round(F.col("l_quantity") - 25, 2))
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("id"), change.alias("change"))
    return numbering.numbered(rows.withColumn("largest", -F.coalesce(F.abs("change"), F.lit(-1.0))), ["largest", "id", "change"], "rank").select("id", "change", "rank")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Rows of a short report with their rank."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("""select id, distance, rank from (select o_orderkey as id, case when o_orderkey % 6 <> 0 then o_totalprice end as distance,
  row_number() over (order by case when o_orderkey % 6 <> 0 then o_totalprice end desc nulls first, o_orderkey) as rank from orders) where rank <= 500""")
def o04_geometry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("distance"))
    order = [F.desc_nulls_first("distance"), "id"]
    return numbered(rows.orderBy(*order).limit(500), order)


@query("select c_nationkey, n_rows, n_poor, cast(row_number() over (order by n_rows desc, n_poor desc, c_nationkey) as bigint) as rank from (select c_nationkey, count(*) as n_rows, count(*) filter (c_acctbal < 0) as n_poor from customer group by c_nationkey)")
def o02_group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("c_acctbal") < 0).alias("n_poor"))
    return numbered(groups, [F.desc("n_rows"), F.desc("n_poor"), "c_nationkey"])


@query("select o_orderpriority, o_orderstatus, count(*) as n_rows from orders group by 1, 2 order by 3 desc, 1, 2 limit 10")
def o06_ordinal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select o_orderpriority, o_orderstatus, count(*) as n_rows from {orders} group by 1, 2 order by 3 desc, 1, 2 limit 10", orders=table(spark, sf_dir, "orders"))


@query("select o_custkey as id from orders where o_totalprice > 300000 union select c_custkey from customer where c_acctbal < 0 union select cast(user_id as bigint) from events where event_type = 'error'")
def u03_excluded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return a.union(b).union(table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id")).distinct()


@query("select 1 as list, c_custkey as id from customer where c_acctbal < 0 union all select 2, s_suppkey from supplier where s_acctbal < 0 union all select 3, p_partkey from part where p_size = 1")
def u04_item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).where(w).select(F.lit(i).alias("list"), F.col(c).alias("id")) for i, (t, w, c) in enumerate((("customer", "c_acctbal < 0", "c_custkey"), ("supplier", "s_acctbal < 0", "s_suppkey"), ("part", "p_size = 1", "p_partkey")), 1)]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("list", "id")


@query("select event_id, row_number() over (order by event_type, event_id) as rid from events")
def w10_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids without gaps over a whole table, found range by range."""
    return numbering.numbered(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type", "event_id"], "rid").select("event_id", "rid")
