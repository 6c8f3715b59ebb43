"""Validation, state probes, reference counts, guards and capped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import columns, values as V
from ..operators import checks, loads
from ..operators.staging import shared_folder
from ..registry import query, table
from ..sources import text_files


@query("""select c_custkey, case when c_custkey % 97 = 0 then 'EMPTY_NAME' when length(c_name) > 20 then 'TOO_LONG' when c_acctbal not between -900 and 9900 then 'RANGE' when c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'ENUM' end as reason from customer""")
def p07_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("EMPTY_NAME", F.col("c_custkey") % 97 == 0), ("TOO_LONG", F.length("c_name") > 20), ("RANGE", ~F.col("c_acctbal").between(-900, 9900)), ("ENUM", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"))]
    return table(spark, sf_dir, "customer").select("c_custkey", checks.first_reason(rules).alias("reason"))


@query("""with r as (select c_custkey, c_name, case when c_acctbal < 0 then 'NEGATIVE' end as reason from customer)
select c_custkey, reason, substr(c_name, 1, 10) as excerpt, (select count(*) from r where reason is not null) as n_total from r where reason is not null order by c_custkey limit 25""")
def k23_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, "NEGATIVE").alias("reason"))
    return checks.rejected(df, "reason", "c_name", ["c_custkey"], 25, 10)


@query("""select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as n_customer, (select count(*) from supplier where s_nationkey = n_nationkey) as n_supplier from nation""")
def j22_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": (table(spark, sf_dir, "customer"), "c_nationkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_nationkey")}
    return checks.reference_counts(table(spark, sf_dir, "nation"), "n_nationkey", tables)


_PAIRS = "(select distinct l_suppkey as a, l_partkey as b from lineitem where l_quantity >= 49)"


@query(f"""with p as (select * from {_PAIRS}), c as (select a, min(b) as b from p where a % 3 = 0 group by a)
select a, b from p where (not exists (select 1 from c where c.a = p.a) and not exists (select 1 from c where c.b = p.b)) or exists (select 1 from c where c.a = p.a and c.b = p.b)""")
def j23_choice_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return checks.prune_choices(pairs.where("a % 3 = 0").groupBy("a").agg(F.min("b").alias("b")), pairs, "a", "b")


@query("""with g as (select o_custkey, count(*) as n from orders group by 1), t as (select *, sum(n) over (order by n desc, o_custkey rows unbounded preceding) as t from g)
select o_custkey, o_orderkey from orders where o_custkey in (select o_custkey from t where t <= 500)""")
def o09_group_safe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return checks.capped_by_group(df.withColumn("group", F.col("o_custkey")), "group", [F.desc("n"), "group"], 500).select("o_custkey", "o_orderkey")


@query("""select event_type, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_rows, count(distinct user_id) as n_users, bool_or(cast(ts as date) = date '2024-01-02') as loaded_that_day from events group by event_type""")
def a22_state_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.bool_or(F.col("ts").cast("date") == F.lit("2024-01-02").cast("date")).alias("loaded_that_day"))


@query("""select o_orderstatus, o_orderpriority, count(*) as n from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders) group by 1, 2""")
def a10_status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct().groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select p_brand, count(distinct p_type) as n_types from part group by 1 having count(distinct p_type) > 1")
def a08_ambiguous_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n_types")).where("n_types > 1")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1995-01-01' and l_partkey is not null)")
def u05_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp '1995-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("""select 'N' as kind, count(*) as n, cast(sum(cast(('0x' || substr(md5(cast(o_orderkey as varchar) || '|' || o_orderstatus), 1, 12)) as bigint)) as varchar) as digest from orders where o_orderkey % 3 = 0
union all select 'C', count(*), cast(sum(cast(('0x' || substr(md5(cast(o_orderkey as varchar) || '|' || o_orderpriority), 1, 12)) as bigint)) as varchar) from orders where o_orderkey % 3 <> 0""")
def u02_plan_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two kinds of planned writes over one union."""
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 3 = 0").select(F.lit("N").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    changed = o.where("o_orderkey % 3 <> 0").select(F.lit("C").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return checks.plan_digest(new.unionByName(changed), "kind", ["k", "v"])


@query("""select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by nullif(c_custkey % 50, 0) nulls last, c_custkey) as rank from customer where c_acctbal > 0""")
def w01_removable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by numeric tail, nulls last, over removable rows only."""
    tail = F.nullif(F.col("c_custkey") % 50, F.lit(0))
    w = Window.partitionBy("c_nationkey").orderBy(tail.asc_nulls_last(), "c_custkey")
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", F.row_number().over(w).cast("long").alias("rank"))


@query("""select o_orderkey, o_custkey, count(*) filter (o_orderstatus = 'F') over (partition by o_custkey) as n_matched, bool_or(o_orderpriority = '1-URGENT') over (partition by o_custkey) as has_urgent from orders""")
def w03_group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group facts on every row, from one row a group joined back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    facts = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_matched"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has_urgent"))
    return o.join(facts, "o_custkey").select("o_orderkey", "o_custkey", "n_matched", "has_urgent")


@query("""select s_suppkey, case when v[1] in ('=', '+', '-', '@') then '''' || v else v end as field from (select s_suppkey, case s_suppkey % 4 when 0 then '=SUM(A1)' when 1 then '-5' when 2 then 'plain' else '+1' end as v from supplier)""")
def k20_guarded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("s_suppkey") % 4
    v = F.when(r == 0, "=SUM(A1)").when(r == 1, "-5").when(r == 2, "plain").otherwise("+1")
    return table(spark, sf_dir, "supplier").select("s_suppkey", loads.csv_field(v, guard=True).alias("field"))


@query("""select cut, o_orderkey from (select cast(o_orderdate as date) as cut, o_orderkey from orders where o_orderkey % 1000 = 0) union all
select cast(o_orderdate as date), o_orderkey from orders where o_orderkey % 1000 <> 0 and cast(o_orderdate as date) not in (select cast(o_orderdate as date) from orders where o_orderkey % 1000 = 0)""")
def k16_append_unless_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("cut"), "o_orderkey")
    return loads.append_unless_loaded(o.where("o_orderkey % 1000 = 0"), o.where("o_orderkey % 1000 <> 0"), "cut").select("cut", "o_orderkey")


@query("select n_nationkey, n_name from nation where contains(lower(n_name), 'nation_1') order by n_name, n_nationkey")
def p14_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where(V.fold(F.col("n_name")).contains("nation_1")).select("n_nationkey", "n_name").orderBy("n_name", "n_nationkey")


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 100 offset 300")
def s02_paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(300).limit(100)


@query("""select column_name as target, case ordinal_position % 3 when 0 then upper(column_name) when 1 then ' ' || replace(column_name, '_', ' ') || ' ' else column_name[1:-2] end as source from information_schema.columns where table_name = 'customer' and (ordinal_position % 3 <> 2 or length(replace(column_name, '_', '')) > 5)""")
def p20_column_automap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table and those of a file that spells them in capitals, with spaces, or a letter short, which is taken for
    names of five letters or more only."""
    names = table(spark, sf_dir, "customer").columns
    spelled = [n.upper() if k % 3 == 0 else f" {n.replace('_', ' ')} " if k % 3 == 1 else n[:-1] for k, n in enumerate(names, 1)]
    return spark.createDataFrame(sorted(columns.auto_map(spelled[::-1], names).items()), "target string, source string")


_PLACES = """(select c_custkey as k, c_custkey % 6 as kind, (c_custkey * 37 % 3600 - 1800) / 10.0 as lng, (c_custkey * 91 % 1800 - 900) / 10.0 as lat from customer)"""


@query(f"""select k, case when kind = 0 then 'POINT(1 ' || k || ')' when kind = 5 then 'POLYGON((0 0,1 0,1 ' || k || ',0 0))' when kind in (1, 2) then 'POINT(' || cast(lng as double) || ' ' || cast(lat as double) || ')' end as geom,
  case when kind = 3 then 'a "quoted"; one' else 'plain' end as note from {_PLACES} where kind <> 4
union all select k, null, 'plain' from {_PLACES} where kind = 4""")
def s13_delimited_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as delimited files, written and read back: quoted fields, and a geometry from its own column or from latitude and
    longitude."""
    c = F.col("c_custkey")
    kind = c % 6
    at = lambda v: F.format_string("%.1f", v)
    lng, lat = at((c * 37 % 3600 - 1800) / 10.0), at((c * 91 % 1800 - 900) / 10.0)
    wkt = F.when(kind == 0, F.concat(F.lit("POINT(1 "), c.cast("string"), F.lit(")"))).when(kind == 5, F.concat(F.lit("POLYGON((0 0,1 0,1 "), c.cast("string"), F.lit(",0 0))"))).when(kind == 2, F.lit("POINT(nowhere)"))
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), wkt.alias("WKT"), F.when(kind == 4, F.lit("north")).when(kind == 3, F.lit(None)).otherwise(F.concat(lat, F.lit(" deg"))).alias("Latitud"), F.when(kind != 3, lng).alias("Lng"), F.when(kind == 3, F.lit('a "quoted"; one')).otherwise("plain").alias("note"))
    folder = shared_folder(spark)
    rows.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(folder)
    # Spark writes an empty first partition as a file that holds its header only: no record, and no fault of the table.
    read = text_files.read_delimited(spark, f"{folder}/*.csv").where("error is null or error <> 'no records'")
    where = text_files.spatial_columns(rows.columns)
    return read.select(F.col("values.id").cast("long").alias("k"), text_files.row_geometry(F.col("values"), where).alias("geom"), F.col("values.note").alias("note"))


@query("select l_orderkey, l_linenumber, l_partkey, 'row' || chr(9) || l_returnflag as raw, 'row\\t' || l_returnflag as encoded from lineitem")
def k09_copy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("row\t"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"), loads.copy_field(raw).alias("encoded"))
