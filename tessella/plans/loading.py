"""Periodic loads: latest cuts, novelty, history, guards, links to masters, catalogue deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins, loads
from ..registry import query, table

#: The day the reports are made for; never the clock's.
AS_OF = "2024-02-01"
_CUTS = "(select cast(date_trunc('month', o_orderdate) as date) as cut, o_custkey as place, cast(round(o_totalprice / 5000, 2) as decimal(9,2)) as pct, case when o_orderstatus = 'F' then 'NO' else 'SI' end as covered, o_orderkey from orders) c"


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as monthly cuts of a coverage indicator per place."""
    return table(spark, sf_dir, "orders").select(
        F.trunc("o_orderdate", "month").alias("cut"), F.col("o_custkey").alias("place"), F.round(F.col("o_totalprice") / 5000, 2).cast("decimal(9,2)").alias("pct"),
        F.when(F.col("o_orderstatus") == "F", "NO").otherwise("SI").alias("covered"), "o_orderkey",
    )


def latest(df: DataFrame) -> DataFrame:
    """The rows of the last cut; its date is one row."""
    return df.join(F.broadcast(df.agg(F.max("cut").alias("cut"))), "cut")


@query(f"select cut, place, cast(pct as double) as pct, covered, o_orderkey from {_CUTS} where cut = (select max(cut) from {_CUTS})")
def o08_latest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(cuts(spark, sf_dir)).select("cut", "place", F.col("pct").cast("double").alias("pct"), "covered", "o_orderkey")


@query(f"select place, cast(pct as double) as pct from {_CUTS} where cut = (select max(cut) from {_CUTS}) and pct > 49.99 and covered = 'SI'")
def x06_over_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(cuts(spark, sf_dir)).where("pct > 49.99 and covered = 'SI'").select("place", F.col("pct").cast("double").alias("pct"))


_SINCE = "(select cast(max(cut) - interval 3 month as date) from {0})".format(_CUTS)


@query(f"""with n as (select place, cut, pct, o_orderkey, row_number() over (partition by place order by cut desc, pct desc, o_orderkey) as r from {_CUTS} where cut > {_SINCE} and pct >= 50 and covered = 'SI'
  and place not in (select place from {_CUTS} where cut <= {_SINCE} and pct >= 50 and place is not null))
select place, cut, cast(pct as double) as pct from n where r = 1""")
def x06_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over the threshold in the last three months that never were before: the newest cut, then the highest share."""
    df = cuts(spark, sf_dir)
    since = df.agg(F.add_months(F.max("cut"), -3).alias("since"))  # one row
    dated = df.where("pct >= 50").join(F.broadcast(since))
    old = dated.where("cut <= since").select("place").distinct()
    new = dated.where("cut > since and covered = 'SI'").join(old, "place", "left_anti")
    return joins.latest_by(new, ["place"], [F.desc("cut"), F.desc("pct"), "o_orderkey"]).select("place", "cut", F.col("pct").cast("double").alias("pct"))


@query("""select n_staged, n_current, round(n_staged / n_current, 6) as ratio, n_staged / n_current >= 0.97 as accepted from
(select count(*) as n_staged from orders where o_orderkey % 50 <> 0), (select count(*) as n_current from orders)""")
def k13_validated_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").select("o_orderkey")
    return loads.validated_swap(current.where("o_orderkey % 50 <> 0"), current)


@query("""select place, cut, o_orderkey from (select cast(date_trunc('month', o_orderdate) as date) as cut, o_custkey as place, o_orderkey from orders where o_orderkey % 211 <> 1)
where cut not in (select cast(date_trunc('month', o_orderdate) as date) from orders where o_orderkey % 211 = 1)
union all select o_custkey, cast(date_trunc('month', o_orderdate) as date), o_orderkey from orders where o_orderkey % 211 = 1""")
def k15_replace_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cuts(spark, sf_dir).select("place", "cut", "o_orderkey")
    return loads.replace_cuts(df.where("o_orderkey % 211 <> 1"), df.where("o_orderkey % 211 = 1"), "cut").select("place", "cut", "o_orderkey")


@query("select greatest(max(o_orderkey) + 1, 1000) as next_value from orders")
def k12_next_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.next_value(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


_WEIGHTS = "select l_suppkey, l_orderkey, l_linenumber, cast(sum(w) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey rows unbounded preceding) as bigint) as t from (select *, cast(l_quantity as bigint) as w from lineitem)"


@query(f"select l_suppkey, l_orderkey, l_linenumber, (t - 1) // 500 as batch from ({_WEIGHTS})")
def o10_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("w"))
    return loads.batches(df, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "w", 500).select("l_suppkey", "l_orderkey", "l_linenumber", "batch")


_RES = """(select page_id, split_part(url, '/', 3) as source, case when page_id % 4 <> 0 then page_id % 7 end as rh, case when page_id % 3 <> 0 then page_id % 5 end as lh,
  case when page_id % 5 <> 0 then page_id % 11 end as rt, case when page_id % 2 <> 0 then page_id % 9 end as lt, length(html) as rs, length(html) - page_id % 2 as ls, page_id % 10 <> 0 as got from pages)"""
_STATE = f"""(select page_id, source, case when not got then 'NOT_DOWNLOADED' when rh is not null and lh is not null and rh <> lh then 'UPDATE_AVAILABLE' when rh is not null and lh is not null then 'UP_TO_DATE'
  when rt is not null and lt is not null and rt > lt then 'UPDATE_AVAILABLE' when not (rt is not null and lt is not null) and rs <> ls then 'UPDATE_AVAILABLE' else 'UP_TO_DATE' end as state from {_RES})"""


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    of = lambda n, m: F.when(p % n != 0, p % m)
    size = F.length("html")
    state = loads.resource_state(of(4, 7), of(3, 5), of(5, 11), of(2, 9), size, size - p % 2, p % 10 != 0)
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), 3).alias("source"), state.alias("state"))


@query(f"select page_id, state from {_STATE}")
def p17_resource_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select("page_id", "state")


@query(f"select source, case max(case state when 'UPDATE_AVAILABLE' then 2 when 'NOT_DOWNLOADED' then 1 else 0 end) when 2 then 'UPDATE_AVAILABLE' when 1 then 'NOT_DOWNLOADED' else 'UP_TO_DATE' end as badge, count(*) as n from {_STATE} group by source")
def a26_source_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).groupBy("source").agg(loads.badge(F.col("state")).alias("badge"), F.count("*").alias("n"))


@query("""with m as (select 'site:master:id:' || s_suppkey as urn, s_suppkey as id from supplier union all select 'site:master:id:' || s_suppkey, s_suppkey + 1000000 from supplier where s_suppkey % 8 = 0),
g as (select urn, count(*) as n, min(id) as id from m where urn is not null group by urn)
select c_custkey, case when g.n is null then 'NEW' when g.n = 1 then 'EXISTING' else 'AMBIGUOUS' end as class, case when g.n = 1 then g.id end as master_id from customer left join g on g.urn = 'site:master:id:' || c_custkey""")
def j21_link_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = lambda c: F.concat(F.lit("site:master:id:"), F.col(c))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    masters = s.select(urn("s_suppkey").alias("urn"), F.col("s_suppkey").alias("id")).union(s.where("s_suppkey % 8 = 0").select(urn("s_suppkey"), F.col("s_suppkey") + 1000000))
    found = masters.groupBy("urn").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    joined = table(spark, sf_dir, "customer").select("c_custkey", urn("c_custkey").alias("urn")).join(found, "urn", "left")
    return joined.select("c_custkey", F.when(F.col("n").isNull(), "NEW").when(F.col("n") == 1, "EXISTING").otherwise("AMBIGUOUS").alias("class"), F.when(F.col("n") == 1, F.col("id")).alias("master_id"))


@query("""select coalesce(d.n_nationkey, o.n_nationkey) as n_nationkey, coalesce(o.label, d.label) as label from (select n_nationkey, n_name as label from nation) d
full join (select cast(n_nationkey + 3 as integer) as n_nationkey, lower(n_name) as label, n_nationkey % 2 = 0 as is_default from nation where n_nationkey % 4 <> 1) o on d.n_nationkey = o.n_nationkey where d.n_nationkey is not null or not o.is_default""")
def p19_merge_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    stored = n.where("n_nationkey % 4 <> 1").select((F.col("n_nationkey") + 3).cast("int").alias("n_nationkey"), F.lower("n_name").alias("label"), (F.col("n_nationkey") % 2 == 0).alias("is_default"))
    return loads.merge_overrides(n.select("n_nationkey", F.col("n_name").alias("label")), stored, "n_nationkey", ["label"])


@query()
def t04_stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, each event kept once; the batch ends with the input. What is kept goes to files that the
    executors write, as are the stream's states."""
    from ..operators.staging import shared_folder
    from ..streaming import pages

    events = table(spark, sf_dir, "events")
    folder = shared_folder(spark)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = pages.without_repeats(stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "event_id", "ts", "3650 days")
    sink = kept.writeStream.format("parquet").option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/states")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/kept")
