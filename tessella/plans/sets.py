"""Unification, conflicts, statistics and samples over keys that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import grouping, joins
from ..registry import query, table

_L = """(select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as rec, case when l_partkey % 40 = 0 then null else l_partkey end as k, l_returnflag as flag,
  case when l_linenumber = 3 then null else l_linestatus end as status from lineitem) l"""
_G = "group by k, case when k is null then rec end"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with a key that is sometimes null. A few lines share order, number and part, and so their rec: their place in the
    table (file, row) orders them."""
    k = F.when(F.col("l_partkey") % 40 != 0, F.col("l_partkey"))
    status = F.when(F.col("l_linenumber") != 3, F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("rec"), k.alias("k"), F.col("l_returnflag").alias("flag"), status.alias("status"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


@query(f"select k, arg_min_null(flag, rec) as flag, arg_min_null(status, rec) as status, min(rec) as rec, count(*) as n_rows from {_L} {_G}")
def a02_unify_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.unify(rows(spark, sf_dir), ["k"], ["flag", "status"], ties=("file", "row")).select("k", "flag", "status", "rec", "n_rows")


@query(f"select cast(count(*) filter (n > 1) as bigint) as n_groups, cast(coalesce(sum(n - 1) filter (n > 1), 0) as bigint) as n_merged from (select count(*) as n from {_L} {_G})")
def a03_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_stats(rows(spark, sf_dir), ["k"])


@query(f"select k, count(*) as n_rows from {_L} {_G} having count(*) > 1 order by n_rows desc, k limit 10")
def a04_largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.largest_groups(rows(spark, sf_dir), ["k"])


@query(f"""with g as (select (count(distinct flag) > 1 or (count(flag) > 0 and count(flag) < count(*))) as a, (count(distinct status) > 1 or (count(status) > 0 and count(status) < count(*))) as b from {_L} {_G})
select 'flag' as "column", cast(count(*) filter (a) as bigint) as n_conflicts from g union all select 'status', cast(count(*) filter (b) as bigint) from g""")
def a05_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.conflicts(rows(spark, sf_dir), ["k"], ["flag", "status"])


@query(f"""select k, arg_min_null(flag, rec) as kept, count(distinct flag) as n_values, array_to_string(list_sort(list_distinct(list(flag)))[1:5], ',') as samples from {_L} where k is not null group by k
having count(distinct flag) > 1 order by k limit 20""")
def a05_conflict_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.conflict_samples(rows(spark, sf_dir).where("k is not null"), ["k"], "flag", 20, ties=("file", "row"))


@query("select event_type, min(event_id) as first, max(event_id) as last, count(*) as n from (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as g from events) group by event_type, g")
def a24_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.islands(table(spark, sf_dir, "events"), "event_id", ["event_type"])


@query("""select event_type, n_group, cast(rank as integer) as rank, event_id from (select *, count(*) over (partition by event_type) as n_group, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 5""")
def w08_capped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return joins.capped_samples(df, ["event_type"], [F.desc("value"), "event_id"], 5).select("event_type", "n_group", "rank", "event_id")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def w11_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return joins.latest_by(df, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("select * from (select o_orderkey, o_totalprice, count(*) over () as n_total from orders where o_orderstatus = 'P') order by o_totalprice desc, o_orderkey limit 50 offset 100")
def o07_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in a fixed order with the total before the limit, which is counted apart from the sort."""
    hit = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return hit.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).join(F.broadcast(hit.agg(F.count("*").alias("n_total"))))  # one row


@query("select c_mktsegment, bool_and(c_acctbal > 0) as all_positive, bool_or(c_acctbal > 9000) as some_large, cast(count(*) filter (c_acctbal < 0) as bigint) as n_negative, string_agg(distinct n_name, ',' order by n_name) as nations from customer join nation on c_nationkey = n_nationkey group by 1 having count(*) > 10")
def a13_boolean_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    found = joined.groupBy("c_mktsegment").agg(F.bool_and(F.col("c_acctbal") > 0).alias("all_positive"), F.bool_or(F.col("c_acctbal") > 9000).alias("some_large"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"), F.count("*").alias("n"))
    return found.where("n > 10").drop("n")


@query("select s_suppkey, array_to_string(list_filter([case when s_acctbal < 0 then 'NEGATIVE' end, case when s_nationkey % 5 = 0 then 'REGION' end, case when s_suppkey % 3 = 0 then 'THIRD' end], lambda x: x is not null), ',') as reasons from supplier")
def a14_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "NEGATIVE"), F.when(F.col("s_nationkey") % 5 == 0, "REGION"), F.when(F.col("s_suppkey") % 3 == 0, "THIRD")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(reasons, ",").alias("reasons"))


@query("""with r as (select md5(concat_ws('|', cast(c_custkey as varchar), c_name, c_mktsegment)) as d from customer),
p as (select substr(d, 1, 3) as p, md5(string_agg(d, '' order by d)) as d, count(*) as n from r group by 1)
select md5(string_agg(d, '' order by p)) as fingerprint, cast(sum(n) as bigint) as n_rows from p""")
def a16_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.fingerprint(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


_LANES = ", ".join(f"sum(cast('0x' || substr(h, {1 + 15 * k}, 15) as bigint)::hugeint) % 2305843009213693951 as l{k}" for k in range(4))
_SAID = " || '|' || ".join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, 'n')" for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_comment_"))


@query(f"""with r as (select sha256({_SAID}) as h from (select *, case when l_linenumber <> 3 then l_linestatus end as l_comment_ from lineitem)), s as (select {_LANES}, count(*) as n_rows from r)
select l0 || '-' || l1 || '-' || l2 || '-' || l3 || '-' || n_rows as fingerprint, n_rows, true as by_changes, true as tells_copies from s""")
def a16_mergeable_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint that is a sum over rows: the same from a part's state, rows that came and rows that went; another one if rows
    stand twice."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_comment_", F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")))
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_comment_"]
    state = lambda df: grouping.multiset_state(df, columns)
    whole, old, came, went = state(rows), state(rows.where("l_quantity < 30")), state(rows.where("l_quantity >= 20")), state(rows.where("l_quantity >= 20 and l_quantity < 30"))
    text = grouping.fingerprint_text
    changed, copied = text(grouping.changed_state(old, came, went)), text(grouping.changed_state(whole, went, state(rows.limit(0))))
    named = text(whole).join(F.broadcast(changed.select(F.col("fingerprint").alias("_c")))).join(F.broadcast(copied.select(F.col("fingerprint").alias("_d"))))  # one row each
    return named.select("fingerprint", "n_rows", (F.col("_c") == F.col("fingerprint")).alias("by_changes"), (F.col("_d") != F.col("fingerprint")).alias("tells_copies"))


@query("select l_returnflag, n from (select l_returnflag, count(*) as n, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as o from lineitem group by 1) order by o")
def o05_class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).orderBy(order)


@query("select r_name, n_name from region join nation on r_regionkey = n_regionkey where r_regionkey in (select n_regionkey from nation where n_name like '%A%' group by n_regionkey)")
def p15_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of which one member meets the criterion."""
    nation = table(spark, sf_dir, "nation")
    hit = nation.where("n_name like '%A%'").select(F.col("n_regionkey").alias("r_regionkey")).distinct()
    return table(spark, sf_dir, "region").join(hit, "r_regionkey", "left_semi").join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")
