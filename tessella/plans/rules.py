"""Row rules, formats, derived codes and verdicts over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry
from ..operators import spatial, texts
from ..operators.staging import spread
from ..registry import query, table
from . import carto, reconciling


@query("""select s_suppkey, substr(s_name, 1, 3) as central, substr(s_name, 10, 4) as zone, regexp_replace(s_name, '0', 'Z') as label, substr(s_name, 1, 3) || '-' || substr(s_name, 15) as code from supplier""")
def p06_derived_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.substring(name, 1, 3).alias("central"), F.substring(name, 10, 4).alias("zone"), texts.replace_first(name, "0", "Z").alias("label"), F.concat(F.substring(name, 1, 3), F.lit("-"), F.substring(name, 15, 100)).alias("code"))


@query("""select c_custkey, replace(c_name, '#', '|Z') as zone_key, trim('  ' || c_mktsegment || ' ') as segment, lpad(cast(c_nationkey as varchar), 3, '0') as nation from customer""")
def f15_zone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("|Z")).alias("zone_key"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("nation"))


@query("select s.s_suppkey, c.c_custkey from supplier s join customer c on 'S' || substr(s.s_name, 15) || '|' || cast(s.s_nationkey as varchar) = 'S' || substr(c.c_name, 15) || '|' || cast(c.c_nationkey as varchar)")
def j07_derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets joined on keys that are built from pieces of their texts."""
    key = lambda name, nation: F.concat(F.lit("S"), F.substring(name, 15, 100), F.lit("|"), F.col(nation).cast("string"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", key("s_name", "s_nationkey").alias("key"))
    return s.join(table(spark, sf_dir, "customer").select("c_custkey", key("c_name", "c_nationkey").alias("key")), "key").select("s_suppkey", "c_custkey")


@query("select p_type, count(*) as n_rows from part where not starts_with(p_name, 'small') group by p_type")
def p08_junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~F.col("p_name").startswith("small")).groupBy("p_type").agg(F.count("*").alias("n_rows"))


@query("select regexp_full_match(case when event_id % 3 = 0 then cast(user_id as varchar) when event_id % 3 = 1 then event_type end, '[0-9]+') is true as whole, count(*) as n_rows from events group by 1")
def p11_integer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 3
    text = F.when(i == 0, F.col("user_id").cast("string")).when(i == 1, F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(texts.is_integer(text).alias("whole")).agg(F.count("*").alias("n_rows"))


@query("select p_partkey from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring') or contains(cast(p_partkey as varchar), 'ring') or contains(cast(p_size as varchar), 'ring')")
def p13_any_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(texts.any_contains(part, "RING", ["p_name", "p_brand", "p_type", "p_partkey", "p_size"])).select("p_partkey")


@query(reconciling._ITEMS + "select type, count(*) as n_rows from items where type in ('ATTRIBUTE_MISMATCH', 'GEOMETRY_MISMATCH', 'ONLY_IN_SHP') and key is not null group by type")
def p16_actionable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconciling.items(spark, sf_dir).where("type in ('ATTRIBUTE_MISMATCH', 'GEOMETRY_MISMATCH', 'ONLY_IN_SHP') and key is not null")
    return found.groupBy("type").agg(F.count("*").alias("n_rows"))


@query("select page_id from pages where upper(trim(' ' || split_part(url, '/', 1) || ' ')) in ('HTTPS:', 'FTP:')")
def p18_format_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.upper(F.trim(F.concat(F.lit(" "), F.split_part("url", F.lit("/"), F.lit(1)), F.lit(" "))))
    return table(spark, sf_dir, "pages").where(form.isin("HTTPS:", "FTP:")).select("page_id")


@query("""select cast(count(*) filter (bad) as bigint) as n_bad, min(p_partkey) filter (bad) as first_id, arg_min(p_brand, p_partkey) filter (bad) as first_value from (select *, not regexp_full_match(p_brand, 'Brand#[0-9]') as bad from part)""")
def p22_key_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ~F.col("p_brand").rlike(r"^Brand#[0-9]\z")
    first = F.min(F.when(bad, F.struct("p_partkey", "p_brand")))
    return table(spark, sf_dir, "part").agg(F.count_if(bad).alias("n_bad"), first.alias("f")).select("n_bad", F.col("f.p_partkey").alias("first_id"), F.col("f.p_brand").alias("first_value"))


_WKT = """case when c_custkey % 50 = 7 then 'POINT(1' when c_custkey % 50 = 8 then 'CIRCLE(1 2)' when c_custkey % 3 = 0 then null
  else 'POLYGON((0 0,' || cast(c_custkey % 9 + 1 as varchar) || ' 0,0 2,0 0))' end"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 50 == 7, "POINT(1").when(k % 50 == 8, "CIRCLE(1 2)").when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("POLYGON((0 0,"), (k % 9 + 1).cast("string"), F.lit(" 0,0 2,0 0))")))
    return table(spark, sf_dir, "customer").select(k, text.alias("wkt"))


@query(f"select c_custkey, {_WKT} as wkt from customer where c_custkey % 50 in (7, 8) order by c_custkey limit 1")
def p23_first_bad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first staged geometry text that isn't one."""
    rows = shapes(spark, sf_dir).where("wkt is not null")
    return rows.where(geometry.geometry_area(F.col("wkt")).isNull()).orderBy("c_custkey").limit(1)


@query(f"select c_custkey, case when c_custkey % 50 not in (7, 8) and c_custkey % 3 <> 0 then cast(c_custkey % 9 + 1 as double) end as area from (select c_custkey, {_WKT} as wkt from customer)")
def g02_wkt_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("c_custkey", geometry.geometry_area(F.col("wkt")).alias("area"))


@query(f"select c_custkey % 9 = 0 as same, count(*) as n_rows from customer where c_custkey % 50 not in (7, 8) and c_custkey % 3 <> 0 group by 1")
def g10_same_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that start elsewhere and run the other way are the same; others aren't."""
    rows = spread(shapes(spark, sf_dir).where("c_custkey % 50 not in (7, 8) and wkt is not null"))
    other = F.lit("MULTIPOLYGON(((0 2,1 0,0 0,0 2)))")
    return rows.groupBy(geometry.same_geometry(F.col("wkt"), other).alias("same")).agg(F.count("*").alias("n_rows"))


@query("select l_returnflag, l_linestatus, count(*) as n_rows from lineitem where l_linestatus <> 'O' group by all having count(*) > 1")
def a09_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'O'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


@query("""select o_orderstatus, to_json(list({'priority': o_orderpriority, 'n': n} order by o_orderpriority)) as report from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) group by o_orderstatus""")
def a15_json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by reason in one JSON text: the reasons of a status are few, the rows are counted before."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return counts.groupBy("o_orderstatus").agg(F.to_json(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("report"))


@query(f"""select b.id, count(*) as n_parts, list_aggregate(list(a.id order by a.id), 'string_agg', ',') as parts, sum({carto._SHARED}) as covered
  from {carto._BLOCK} b join {carto._PARCEL} a on {carto._MEET} where {carto._SHARED} > 0 group by b.id""")
def a18_split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block is split into. A block holds few parcels: its area bounds them."""
    pairs = spatial.box_join(carto.parcels(spark, sf_dir), carto.blocks(spark, sf_dir), carto.CELL).where("shared > 0")
    return pairs.groupBy(F.col("b_id").alias("id")).agg(F.count("*").alias("n_parts"), F.array_join(F.array_sort(F.collect_list("a_id")), ",").alias("parts"), F.sum("shared").alias("covered"))


@query(f"select id, block, shared from (select a.id, b.id as block, {carto._SHARED} as shared, row_number() over (partition by a.id order by {carto._SHARED} desc, b.id) as nth from {carto._PARCEL} a join {carto._BLOCK} b on {carto._MEET}) where nth = 1 and shared > 0")
def j20_best_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that shares most with each parcel."""
    pairs = spatial.box_join(carto.parcels(spark, sf_dir), carto.blocks(spark, sf_dir), carto.CELL).where("shared > 0")
    best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.max(F.struct("shared", (-F.col("b_id")).alias("b"))).alias("m"))
    return best.select("id", (-F.col("m.b")).alias("block"), F.col("m.shared").alias("shared"))


@query("select case when p_size % 7 <> 0 then p_type end as subsystem, count(*) as n_rows, cast(row_number() over (order by case when p_size % 7 <> 0 then p_type end nulls last) as bigint) as rank from part group by 1")
def a21_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .upkeep import numbered

    counts = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("subsystem")).agg(F.count("*").alias("n_rows"))
    return numbered(counts, [F.asc_nulls_last("subsystem")])


@query("""select (select count(*) from events) as n_staged, (select count(*) from events where event_type <> 'error') as n_loaded, (select count(*) from events where event_type = 'error') as n_junk, true as consistent""")
def a27_load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was staged is what was loaded and what was thrown out."""
    out = table(spark, sf_dir, "events").agg(F.count("*").alias("n_staged"), F.count_if(F.col("event_type") != "error").alias("n_loaded"), F.count_if(F.col("event_type") == "error").alias("n_junk"))
    return out.withColumn("consistent", F.col("n_staged") == F.col("n_loaded") + F.col("n_junk"))


@query("""select count(*) as n_rows, cast(count(*) filter (n.n_nationkey is not null) as bigint) as n_matched, case when count(*) = count(n.n_nationkey) then 'MATCHES' when count(n.n_nationkey) = 0 then 'UNRELATED' else 'PARTIAL' end as verdict
  from customer c left join (select n_nationkey from nation where n_regionkey <> 2) n on c.c_nationkey = n.n_nationkey""")
def a28_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    out = table(spark, sf_dir, "customer").join(names, "c_nationkey", "left").agg(F.count("*").alias("n_rows"), F.count("known").alias("n_matched"))
    return out.withColumn("verdict", F.when(F.col("n_rows") == F.col("n_matched"), "MATCHES").when(F.col("n_matched") == 0, "UNRELATED").otherwise("PARTIAL"))


@query("select c_custkey, cast(cast(trunc(c_acctbal) as bigint) as varchar) as whole from customer")
def f16_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("bigint").cast("string").alias("whole"))


@query("select p_partkey, upper(trim('  ' || p_name || ' ')) as name from part where upper(trim(p_name)) like '% RING'")
def f17_upper_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.upper(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))))
    return table(spark, sf_dir, "part").where(name.like("% RING")).select("p_partkey", name.alias("name"))


@query("select o_orderkey, strftime(o_orderdate, '%d-%m-%Y') as shown, strftime(o_orderdate, '%Y%m%d') as compact, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::date as day from orders")
def f19_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "dd-MM-yyyy").alias("shown"), F.date_format(day, "yyyyMMdd").alias("compact"), F.to_date(F.date_format(day, "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"))


@query("""select doc_id, len(list_filter(w, lambda x: length(x) > 6)) as n_long, list_bool_or(list_transform(w, lambda x: x = 'the')) as has_the, list_bool_and(list_transform(w, lambda x: length(x) > 0)) as all_full, len(w) as n_words
  from (select doc_id, string_split(text, ' ') as w from documents where text is not null)""")
def f24_array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ", -1).alias("w"))
    return words.select("doc_id", F.size(F.filter("w", lambda x: F.length(x) > 6)).cast("long").alias("n_long"), F.exists("w", lambda x: x == "the").alias("has_the"), F.forall("w", lambda x: F.length(x) > 0).alias("all_full"), F.size("w").cast("long").alias("n_words"))


#: An ordered rule table: pattern of the original name, text, replacement.
SHORT = [("%small%", "small", "sm"), ("%widget%", "widget", "wdg"), ("%red%", "red ", "r."), ("%", "ring", "rg")]
_SHORT = "p_name"
for _like, _old, _new in SHORT:
    _SHORT = f"(select case when p_name like '{_like}' and length(v) > 8 then replace(v, '{_old}', '{_new}') else v end from (select {_SHORT} as v))"


@query(f"select p_partkey, trim({_SHORT}) as name from part")
def f11_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", texts.shorten(F.col("p_name"), SHORT, 8).alias("name"))


@query("select c_custkey, upper(c_name) as name, c_acctbal as balance from customer where c_mktsegment = 'MACHINERY'")
def p01_resolved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named in another case."""
    customer = table(spark, sf_dir, "customer")
    c = lambda name: F.col(f"`{texts.resolve(customer.columns, name)}`")
    return customer.where(c("C_MktSegment") == "MACHINERY").select("c_custkey", F.upper(c("C_NAME")).alias("name"), c("c_AcctBal").alias("balance"))


@query("""select p_partkey as id, date '2024-01-31' as loaded, 'part' as source, (maxx - minx) * (maxy - miny) as area, round((maxx - minx) * (maxy - miny) / 7, 2) as area_7, (minx + maxx) / 2 as lon, (miny + maxy) / 2 as lat
  from (select id as p_partkey, minx, miny, maxx, maxy from """ + carto._PARCEL + ")")
def p05_computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return carto.parcels(spark, sf_dir).select("id", F.lit("2024-01-31").cast("date").alias("loaded"), F.lit("part").alias("source"), area.alias("area"), F.round(area / 7, 2).alias("area_7"), ((F.col("minx") + F.col("maxx")) / 2).alias("lon"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))


@query("""select urn, string_agg(reason, ',' order by reason) as blockers from (
  select c_custkey as urn, 'HAS_ORDERS' as reason from customer where c_acctbal < 0 and c_custkey in (select o_custkey from orders)
  union all select c_custkey, 'IN_EVENTS' from customer where c_acctbal < 0 and c_custkey in (select user_id from events)
  union all select c_custkey, 'PROTECTED' from customer where c_acctbal < 0 and c_nationkey % 5 = 0) group by urn""")
def p28_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row may not be removed: the tables that refer to it, and its own protection."""
    roots = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("urn"), "c_nationkey")
    refers = lambda name, column, reason: roots.join(table(spark, sf_dir, name).select(F.col(column).alias("urn")), "urn", "left_semi").select("urn", F.lit(reason).alias("reason"))
    found = refers("orders", "o_custkey", "HAS_ORDERS").union(refers("events", "user_id", "IN_EVENTS")).union(roots.where("c_nationkey % 5 = 0").select("urn", F.lit("PROTECTED")))
    return found.groupBy("urn").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("blockers"))


@query("""select n_staged, n_current, n_days, case when n_staged = 0 then 'EMPTY' end as blocker, concat_ws(',', case when n_staged < 0.97 * n_current then 'SHRINKS' end, case when n_days > 1 then 'SEVERAL_DATES' end) as warnings, n_staged > 0 as can_load
  from (select (select count(*) from orders where o_orderkey % 20 <> 0) as n_staged, (select count(*) from orders) as n_current, (select count(distinct cast(o_orderdate as date)) from orders where o_orderkey % 20 <> 0) as n_days)""")
def p25_load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, blockers and warnings of a load, in one row."""
    staged = F.col("o_orderkey") % 20 != 0
    facts = table(spark, sf_dir, "orders").agg(F.count_if(staged).alias("n_staged"), F.count("*").alias("n_current"), F.countDistinct(F.when(staged, F.to_date("o_orderdate"))).alias("n_days"))
    warnings = F.concat_ws(",", F.when(F.col("n_staged") < 0.97 * F.col("n_current"), "SHRINKS"), F.when(F.col("n_days") > 1, "SEVERAL_DATES"))
    return facts.select("*", F.when(F.col("n_staged") == 0, "EMPTY").alias("blocker"), warnings.alias("warnings"), (F.col("n_staged") > 0).alias("can_load"))


@query("select urn, kind, n from (values (1, 'KEEP', 5), (2, 'DROP', null)) t(urn, kind, n) union all select c_custkey, 'SAME', c_nationkey from customer where c_custkey = 3")
def s28_typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User choices as rows of fixed types, beside a table; an empty list keeps the shape."""
    shape = "urn long, kind string, n int"
    rows = spark.createDataFrame([(1, "KEEP", 5), (2, "DROP", None)], shape).union(spark.createDataFrame([], shape))
    return rows.union(table(spark, sf_dir, "customer").where("c_custkey = 3").select("c_custkey", F.lit("SAME"), "c_nationkey"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def s06_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of JSON rows read back into rows."""
    chunks = table(spark, sf_dir, "events").select(F.to_json(F.array(F.struct("event_id", "props"))).alias("line"))
    rows = chunks.select(F.inline(F.from_json("line", "array<struct<event_id:long,props:string>>")))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
