"""Text rules over documents and customers: staging quality, skip reasons, search, exports, repair, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import values as V
from ..operators import grouping, joins, loads
from ..registry import query, table


@query("""with g as (select lang, source, substr(text, 1, 3) as head, count(*) as n, count(*) filter (text is null or trim(text) = '') as m0, count(*) filter (lang is null or trim(lang) = '') as m1, count(*) filter (contains(text, '�')) as d from documents group by 1, 2, 3)
select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct, cast(count(*) filter (n > 1) as bigint) as n_repeated_groups, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as n_repeated_rows, cast(sum(m0 + m1) as bigint) as n_missing, cast(sum(d) as bigint) as n_damaged from g""")
def a20_staging_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 3))
    return grouping.staging_checks(df, ["lang", "source", "head"], ["text", "lang"], "text")


_REASON = """case when text is null or trim(text) = '' then 'EMPTY' when n_chars > 5000 then 'TOO_LONG' when lang not in ('en', 'fr', 'de', 'es') then 'LANGUAGE' when regexp_matches(text, '[0-9]{3}') then 'NUMBERS' end"""


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason in a fixed order for which a document is skipped."""
    c = F.col
    reason = F.when(c("text").isNull() | (F.trim("text") == ""), "EMPTY").when(c("n_chars") > 5000, "TOO_LONG").when(~c("lang").isin("en", "fr", "de", "es"), "LANGUAGE").when(c("text").rlike("[0-9]{3}"), "NUMBERS")
    return table(spark, sf_dir, "documents").select("doc_id", "source", reason.alias("reason")).where("reason is not null")


@query(f"select doc_id, {_REASON} as reason from documents where {_REASON} is not null")
def p09_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skips(spark, sf_dir).select("doc_id", "reason")


@query(f"""select reason, n_group, cast(rank as integer) as rank, doc_id from (select reason, doc_id, count(*) over (partition by reason) as n_group, row_number() over (partition by reason order by doc_id) as rank from (select doc_id, {_REASON} as reason from documents) where reason is not null) where rank <= 10""")
def w08_skip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.capped_samples(skips(spark, sf_dir), ["reason"], ["doc_id"], 10).select("reason", "n_group", "rank", "doc_id")


@query("select c_custkey from customer where contains(lower(c_name), '7') and (contains(lower(c_mktsegment), 'auto') or contains(lower(c_mktsegment), 'build'))")
def p12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, s: F.lower(c).contains(s)
    return table(spark, sf_dir, "customer").where(has("c_name", "7") & (has("c_mktsegment", "auto") | has("c_mktsegment", "build"))).select("c_custkey")


@query("""select p_partkey, concat_ws(',', cast(p_partkey as varchar), case when contains(p_name, ',') or contains(p_name, '"') then '"' || replace(p_name, '"', '""') || '"' else p_name end, case when p_brand is null then '' else p_brand end) as line from part""")
def k19_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", loads.csv_line(["p_partkey", "p_name", "p_brand"]).alias("line"))


@query("select s_suppkey, case when contains(t, '.') then regexp_replace(regexp_replace(t, '0+$', ''), '\\.$', '') else t end as pct from (select s_suppkey, cast(cast(s_suppkey * 5 % 1000 / 10 as decimal(5,2)) as varchar) as t from supplier)")
def f10_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.percentage_text((F.col("s_suppkey") * 5 % 1000 / 10).cast("decimal(5,2)")).alias("pct"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then null else s_suppkey end as tail from supplier")
def f14_urn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = F.when(F.col("s_suppkey") % 3 == 0, "site:x:none").otherwise(F.concat(F.lit("site:x:id:"), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.urn_tail(urn).alias("tail"))


@query("select c_custkey, case when v in ('S/N', 'SN', '0', '', 'N/A') then 'NONE' else v end as segment from (select c_custkey, upper(trim(case c_custkey % 5 when 0 then ' s/n ' when 1 then '0' when 2 then '' when 3 then null else c_mktsegment end)) as v0, coalesce(v0, '') as v from customer)")
def f12_key_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("c_custkey") % 5
    raw = F.when(r == 0, " s/n ").when(r == 1, "0").when(r == 2, "").when(r == 4, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.key_segment(raw).alias("segment"))


@query("select l_orderkey, l_linenumber, l_partkey, floor((l_discount - 0.05) * 100 + 0.5) / 100 as r from lineitem")
def f23_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.half_up(F.col("l_discount") - 0.05, 100.0).alias("r"))


@query("select event_id, cast(try_strptime(t, '%Y%m%d') as date) as day from (select event_id, case when event_id % 4 = 0 then '20240230' when event_id % 4 = 1 then '20240229' else strftime(ts, '%Y%m%d') end as t from events)")
def f21_calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, "20240230").when(F.col("event_id") % 4 == 1, "20240229").otherwise(F.date_format("ts", "yyyyMMdd"))
    return table(spark, sf_dir, "events").select("event_id", V.valid_date(text, "yyyyMMdd").alias("day"))


@query("select doc_id, text from documents where lang in ('fr', 'es')")
def f04_repair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts mis-decoded on purpose come back as they were."""
    df = table(spark, sf_dir, "documents").where("lang in ('fr', 'es')")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return df.select("doc_id", F.when(F.col("text").rlike("[ÃÂ]"), F.col("text")).otherwise(V.repair_encoding(broken)).alias("text"))
