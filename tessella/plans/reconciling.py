"""Reconciliation of orders with a perturbed copy, pairing of repeated keys, duplicate decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import dedup, joins, pairing, reconcile
from ..registry import query, table

CFG = reconcile.ReconcileConfig(keys=("okey",), compared=("status", "priority"), source_of={"status": "st", "priority": "pr"}, source_keys=("skey",))

#: Both sides as SQL for the oracle: orders with repeated keys of all kinds, and a perturbed copy.
TARGET = """
select o_orderkey as okey, o_orderstatus as status, o_orderpriority as priority, o_orderkey as rec from orders
union all select o_orderkey, o_orderstatus, o_orderpriority, o_orderkey + 600000000 from orders where o_orderkey % 100 = 5
union all select o_orderkey, 'Y', o_orderpriority, o_orderkey + 700000000 from orders where o_orderkey % 100 in (6, 7, 8)
union all select o_orderkey, 'U', o_orderpriority, o_orderkey + 800000000 from orders where o_orderkey % 100 = 8
"""
SOURCE = """
select case when o_orderkey % 1009 = 0 then '' when o_orderkey % 7 = 0 then concat(cast(o_orderkey as varchar), '.0') else cast(o_orderkey as varchar) end as skey,
  case when o_orderkey % 13 = 0 then 'X' when o_orderkey % 7 = 0 then concat(' ', o_orderstatus, ' ') else o_orderstatus end as st,
  case when o_orderkey % 11 = 0 then null else o_orderpriority end as pr, o_orderkey as rec
from orders where o_orderkey % 97 <> 0
union all select concat('N', cast(o_orderkey as varchar)), o_orderstatus, o_orderpriority, o_orderkey + 100000000 from orders where o_orderkey % 500 = 1
union all select concat('D', cast(o_orderkey as varchar)), o_orderstatus, o_orderpriority, o_orderkey + 200000000 from orders where o_orderkey % 1000 = 2
union all select concat('D', cast(o_orderkey as varchar)), 'Z', o_orderpriority, o_orderkey + 300000000 from orders where o_orderkey % 1000 = 2
union all select concat('E', cast(o_orderkey as varchar)), o_orderstatus, o_orderpriority, o_orderkey + 400000000 from orders where o_orderkey % 1000 = 3
union all select concat('E', cast(o_orderkey as varchar)), o_orderstatus, o_orderpriority, o_orderkey + 500000000 from orders where o_orderkey % 1000 = 3
union all select cast(o_orderkey as varchar), 'Z', o_orderpriority, o_orderkey + 900000000 from orders where o_orderkey % 100 in (4, 7, 8)
"""


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same in one pass over orders a side: each order is expanded to its rows."""
    orders = table(spark, sf_dir, "orders")
    o, text, status, priority = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")

    def expanded(names, *rows):
        made = [F.when(keep, F.struct(*[v.alias(n) for v, n in zip(values, names)])) for keep, *values in rows]
        return orders.select(F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))

    d, under = o % 100, lambda letter: F.concat(F.lit(letter), text)
    target = expanded(
        ("okey", "status", "priority", "rec"), (F.lit(True), o, status, priority, o), (d == 5, o, status, priority, o + 600000000),
        (d.isin(6, 7, 8), o, F.lit("Y"), priority, o + 700000000), (d == 8, o, F.lit("U"), priority, o + 800000000),
    )
    key = F.when(o % 1009 == 0, "").when(o % 7 == 0, F.concat(text, F.lit(".0"))).otherwise(text)
    st = F.when(o % 13 == 0, "X").when(o % 7 == 0, F.concat(F.lit(" "), status, F.lit(" "))).otherwise(status)
    source = expanded(
        ("skey", "st", "pr", "rec"), (o % 97 != 0, key, st, F.when(o % 11 != 0, priority), o), (o % 500 == 1, under("N"), status, priority, o + 100000000),
        (o % 1000 == 2, under("D"), status, priority, o + 200000000), (o % 1000 == 2, under("D"), F.lit("Z"), priority, o + 300000000),
        (o % 1000 == 3, under("E"), status, priority, o + 400000000), (o % 1000 == 3, under("E"), status, priority, o + 500000000), (d.isin(4, 7, 8), text, F.lit("Z"), priority, o + 900000000),
    )
    return target, source


_CLEAN = r"regexp_replace(trim(coalesce({0}, '')), '\.0$', '')"
_ITEMS = f"""
with tgt as ({TARGET}), src as ({SOURCE}),
t as (select cast(okey as varchar) as key, coalesce(status, '') as a, coalesce(priority, '') as b, rec from tgt),
s as (select nullif(lower({_CLEAN.format("skey")}), '') as key, {_CLEAN.format("st")} as a, {_CLEAN.format("pr")} as b, rec from src),
tn as (select *, row_number() over (partition by key, a, b order by rec) as nth from t),
sn as (select *, row_number() over (partition by key, a, b order by rec) as nth from s where key is not null),
reps as (select coalesce(x.key, y.key) as key, x.rec as db_rec, y.rec as file_rec, x.a as ta, x.b as tb, y.a as sa, y.b as sb, x.key is not null as in_t, y.key is not null as in_s
  from (select * from tn where nth = 1) x full outer join (select * from sn where nth = 1) y on x.key = y.key and x.a = y.a and x.b = y.b),
k as (select key, bool_or(in_t) as has_t, count(*) filter (in_s) as kinds, count(*) filter (in_t and not in_s) as lt, count(*) filter (in_s and not in_t) as ls from reps group by key),
alone as (select r.*, k.lt, k.ls from reps r join k on r.key = k.key where k.has_t and not (in_t and in_s)),
items as (
  select key, 'MATCH' as type, '' as changed, db_rec, file_rec, 1 as n_rows from reps where in_t and in_s
  union all select x.key, 'ATTRIBUTE_MISMATCH', concat_ws(',', case when x.ta <> y.sa then 'status' end, case when x.tb <> y.sb then 'priority' end), x.db_rec, y.file_rec, 1
    from alone x join alone y on x.key = y.key and x.in_t and y.in_s where x.lt = 1 and x.ls = 1
  union all select key, case when ls = 0 then 'ONLY_IN_DB' when lt = 0 then 'ONLY_IN_SHP' else 'DUPLICATE_SUID' end, null, db_rec, file_rec, 1 from alone where not (lt = 1 and ls = 1)
  union all select key, 'DUPLICATE_SUID', null, rec, null, 1 from tn where nth > 1
  union all select r.key, 'ONLY_IN_SHP', null, null, r.file_rec, 1 from reps r join k on r.key = k.key where not k.has_t and kinds = 1
  union all select sn.key, 'DUPLICATE_SUID', null, null, rec, 1 from sn join k on sn.key = k.key where not k.has_t and kinds > 1
  union all select null, 'NULL_SUID', null, null, rec, 1 from s where key is null
  union all select sn.key, 'SKIPPED_TWIN', null, null, min(rec), count(*) - 1 from sn join k on sn.key = k.key where k.has_t or kinds = 1 group by sn.key, a, b having count(*) > 1
)
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.items(*both_sides(spark, sf_dir), CFG)


@query(_ITEMS + "select key, type, changed, db_rec, file_rec, cast(n_rows as bigint) as n_rows from items")
def x01_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which target rows differ from the source, and how."""
    return items(spark, sf_dir).select("key", "type", F.array_join(F.transform("differences", lambda d: d.field), ",").alias("changed"), "db_rec", "file_rec", "n_rows")


_OF = ", ".join(f"cast(coalesce(sum(n_rows) filter (type = '{t}'), 0) as bigint) as n_{t.lower()}" for t in reconcile.TYPES)


@query(_ITEMS + f"select {_OF}, cast(sum(n_rows) as bigint) as n_total, cast((select count(*) from tgt) + (select count(*) from src) as bigint) as n_rows from items")
def a01_reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle counts n_rows on the two sides themselves: nothing is lost and nothing counts twice."""
    return reconcile.summary(items(spark, sf_dir))


_SAID = "coalesce(chr(39) || replace({0}, chr(39), chr(39) || chr(39)) || chr(39), 'NULL')"


@query(_ITEMS + f"""select i.key, 'UPDATE "orders" SET ' || concat_ws(', ', case when contains(changed, 'status') then '"status" = ' || {_SAID.format("r.st")} end,
  case when contains(changed, 'priority') then '"priority" = ' || {_SAID.format("r.pr")} end) || ' WHERE "okey" = ' || {_SAID.format("cast(g.okey as varchar)")} as statement
  from items i join src r on i.file_rec = r.rec join tgt g on i.db_rec = g.rec where type = 'ATTRIBUTE_MISMATCH'
  union all select i.key, 'INSERT INTO "orders" ("okey", "status", "priority") VALUES (' || concat_ws(', ', {_SAID.format("r.skey")}, {_SAID.format("r.st")}, {_SAID.format("r.pr")}) || ')'
  from items i join src r on i.file_rec = r.rec where type = 'ONLY_IN_SHP'""")
def k01_sql_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = both_sides(spark, sf_dir)
    return reconcile.sql_patches(reconcile.items(target, source, CFG), target, source, "orders", CFG)


PAIR = reconcile.ReconcileConfig(keys=("k",), compared=("flag", "status"))


@query("""
with t as (select cast(l_orderkey as varchar) as key, concat(l_returnflag, '|', l_linestatus) as sig, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as rec from lineitem),
s as (select key, case when rec % 5 = 0 then 'Q|' || split_part(sig, '|', 2) else sig end as sig, rec from t where rec % 7 <> 0),
k as (select t.key from (select key, count(*) n from t group by key) t left join (select key, count(*) n from s group by key) s on t.key = s.key where t.n > 1 or s.n > 1),
b as (select coalesce(a.key, c.key) as key, coalesce(a.sig, c.sig) as sig, a.rec as db_rec, c.rec as file_rec
  from (select key, sig, min(rec) as rec from t where key in (select key from k) group by all) a
  full outer join (select key, sig, min(rec) as rec from s where key in (select key from k) group by all) c on a.key = c.key and a.sig = c.sig),
l as (select * from b where db_rec is null or file_rec is null),
n as (select key, count(db_rec) as tn, count(file_rec) as sn, max(db_rec) as t1, max(file_rec) as s1 from l group by key)
select key, 'EXACT' as method, db_rec, file_rec from b where db_rec is not null and file_rec is not null
union all select key, 'ELIMINATION', t1, s1 from n where tn = 1 and sn = 1
union all select l.key, case when sn = 0 then 'ONLY_IN_DB' when tn = 0 then 'ONLY_IN_SHP' else 'NO_GEOMETRY' end, db_rec, file_rec from l join n on l.key = n.key where not (tn = 1 and sn = 1)
union all select key, 'DUPLICATE_SUID', rec, null from t where key in (select key from k) and (key, sig, rec) not in (select (key, sig, min(rec)) from t group by key, sig)
""")
def j03_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing inside repeated keys: lineitem by order against a perturbed copy."""
    rec = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), rec.alias("rec"))
    s = t.where("rec % 7 <> 0").withColumn("flag", F.when(F.col("rec") % 5 == 0, "Q").otherwise(F.col("flag")))
    return reconcile.exact_pairs(t, s, PAIR).select("key", "method", "db_rec", "file_rec")


_ROWS = """
select concat(n_name, '|', c_mktsegment, '|', cast(cast(floor(c_acctbal / 100) as bigint) as {text})) as match_key, c_custkey as urn, c_mktsegment as source,
  c_nationkey % 5 = 0 and c_custkey % 3 = 0 as protected, c_custkey % 4 = 1 as evidence
from customer join nation on c_nationkey = n_nationkey
"""
_DECIDED = f"""
with r as ({_ROWS.format(text="varchar")}),
g as (select match_key, count(*) as n_group, bool_or(protected) as p, min(urn) filter (not protected and not evidence) as least from r where match_key is not null group by match_key),
x as (select r.*, n_group, case when n_group = 1 then 'SINGLE' when protected then 'PROTECTED' when evidence then 'IN_USE' when p then 'REDUNDANT_TO_PROTECTED' when urn = least then 'FIRST_OF_GROUP' else 'REDUNDANT' end as reason
  from r join g on r.match_key = g.match_key),
d as (select *, case when not protected and not evidence and reason like 'REDUNDANT%' then 'REMOVE' when reason = 'IN_USE' then 'REVIEW' else 'KEEP' end as decision from x)
"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    rows = spark.sql(_ROWS.format(text="string").replace("from customer join nation", "from {customer} join {nation}"), **views)
    return dedup.decide(rows, "match_key", "urn", "protected", "evidence")


@query(_DECIDED + "select match_key, urn, n_group, reason, decision, cast(dense_rank() over (order by match_key) as integer) as group_id from d")
def x04_dedup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_group_ids(decided(spark, sf_dir), "match_key").select("match_key", "urn", "n_group", "reason", "decision", "group_id")


@query(_DECIDED + "select decision, source, count(*) as n_rows, cast(count(*) filter (n_group > 1) as bigint) as n_grouped from d group by decision, source")
def a17_dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(decided(spark, sf_dir), "source")


@query(_DECIDED + "select urn, string_agg(distinct reason, ',' order by reason) as reasons, count(*) as n_rows from d group by urn having bool_and(decision = 'REMOVE')")
def x05_removal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.removal_targets(decided(spark, sf_dir), "urn")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity < 2)")
def j10_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity < 2").select("l_partkey")
    return joins.not_in(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey", "l_partkey")


@query("select p_partkey from part where p_partkey not in (select case when l_partkey % 50 = 0 then null else l_partkey end from lineitem)")
def j10_not_in_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("k"))
    return joins.not_in(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey", "k")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j11_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("""
with h as (select l_orderkey, l_partkey from lineitem where l_linenumber <= 2 group by all having count(*) > 1),
g as (select l_suppkey, l_partkey from lineitem where l_quantity > 45 group by all having count(*) > 1)
select 'A' as sheet, l_orderkey as k1, l_partkey as k2, l_linenumber from lineitem join h using (l_orderkey, l_partkey) where l_linenumber <= 2
union all select 'B', l_suppkey, l_partkey, l_linenumber from lineitem join g using (l_suppkey, l_partkey) where l_quantity > 45
""")
def j09_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key repeats within their sheet, of two sheets."""
    items = table(spark, sf_dir, "lineitem")

    def repeated(df, a, name):
        keys = df.groupBy(a, "l_partkey").count().where("count > 1").drop("count")
        return df.join(keys, [a, "l_partkey"]).select(F.lit(name).alias("sheet"), F.col(a).alias("k1"), F.col("l_partkey").alias("k2"), "l_linenumber")

    return repeated(items.where("l_linenumber <= 2"), "l_orderkey", "A").unionByName(repeated(items.where("l_quantity > 45"), "l_suppkey", "B"))


@query("""
with h as (select o_custkey, o_orderstatus, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderdate < timestamp '1996-01-01'),
c as (select o_custkey, o_orderstatus, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
select c.o_custkey, h.o_orderstatus as was, c.o_orderstatus as is_now from h right join c on h.o_custkey = c.o_custkey and h.r = 1
where c.r = 1 and h.o_orderstatus <> c.o_orderstatus and (h.o_orderstatus = 'F' or (h.o_orderstatus = 'P' and c.o_orderstatus <> 'F'))
""")
def j08_state_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose latest order's state falls behind the state of their latest order before a date."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    last = lambda df: joins.latest_by(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    before = last(orders.where("o_orderdate < timestamp '1996-01-01'")).select("o_custkey", F.col("o_orderstatus").alias("was"))
    now = last(orders).select("o_custkey", F.col("o_orderstatus").alias("is_now"))
    return before.join(now, "o_custkey", "right").where("was <> is_now and (was = 'F' or (was = 'P' and is_now <> 'F'))")


@query("""
with d as (select upper(trim(n_name)) as n, count(*) as c, min(n_nationkey) as i from (select n_name, n_nationkey from nation union all select lower(n_name), n_nationkey + 100 from nation where n_nationkey % 6 = 0) group by 1)
select s_suppkey, coalesce(c, 0) as n_matches, case when c = 1 then i end as match_id
from (select s_suppkey, case when s_suppkey % 9 = 0 then 'NOWHERE' else lower(n_name) end as name from supplier join nation on s_nationkey = n_nationkey) s left join d on upper(trim(s.name)) = d.n
""")
def j13_dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    dim = nation.union(nation.where("n_nationkey % 6 = 0").select(F.lower("n_name"), (F.col("n_nationkey") + 100).cast("int")))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # a nation table is 25 rows
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "NOWHERE").otherwise(F.lower("n_name")).alias("name"))
    return joins.lookup(s, "name", dim, "n_name", "n_nationkey").select("s_suppkey", "n_matches", "match_id")


@query("""select l_orderkey, l_linenumber, count(*) over (partition by l_partkey, l_quantity > 25) as n_key from lineitem""")
def w06_key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("big"))
    return items.join(items.groupBy("l_partkey", "big").agg(F.count("*").alias("n_key")), ["l_partkey", "big"]).select("l_orderkey", "l_linenumber", "n_key")


@query("""
with p as (select distinct o_custkey as a, o_orderdate as b from orders where o_orderstatus = 'P')
select a, b from (select *, count(*) over (partition by a) as x, count(*) over (partition by b) as y from p) where x = 1 and y = 1
""")
def w07_mutual_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), F.col("o_orderdate").alias("b")).distinct()
    return joins.mutual_unique(pairs, "a", "b")


@query("""
with recursive t as (select cast(l_orderkey as varchar) as key, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as rec, max(l_quantity) as x, max(l_discount) * 100 as y, max(l_returnflag) as a, max(l_linestatus) as b from lineitem group by all),
s as (select key, rec, x + (rec % 5) / 10 as x, y, a, b from t where rec % 3 <> 0),
e as (select t.key, t.rec as d, s.rec as f, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) as far, cast(t.a <> s.a as int) + cast(t.b <> s.b as int) as n from t join s on t.key = s.key),
l as (select key, list(struct_pack(q := floor(far / 0.0001 + 0.5), n := n, d := d, f := f, far := far) order by floor(far / 0.0001 + 0.5), n, d, f) as edges from e group by key),
r as (select key, edges, cast(null as struct(q double, n integer, d bigint, f bigint, far double)) as p from l
  union all select key, list_filter(edges, lambda e: e.d <> edges[1].d and e.f <> edges[1].f), edges[1] from r where len(edges) > 0),
p as (select key, p.d as d, p.f as f, p.far as far from r where p is not null),
left_ as (select key, rec as d, null as f from t where rec not in (select d from p) union all select key, null, rec from s where rec not in (select f from p))
select key, 'GEOMETRY' as method, d as db_rec, f as file_rec, round(far, 6) as distance from p
union all select key, 'UNPAIRED', d, f, null from left_
""")
def j03_nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows of an order, as points, paired with shifted copies; what is left over comes back from both sides."""
    rec = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key"), rec.alias("rec"))
    t = rows.agg(F.max("l_quantity").alias("x"), (F.max("l_discount") * 100).alias("y"), F.array(F.max("l_returnflag"), F.max("l_linestatus")).alias("attributes"))
    s = t.where("rec % 3 <> 0").withColumn("x", F.col("x") + (F.col("rec") % 5) / 10)
    return pairing.nearest_pairs(t, s).withColumn("distance", F.round("distance", 6))


#: Orders with geometry: the source's shapes are turned, reversed, moved, missing, collapsed or kept, by o_orderkey % 12.
SHAPED = reconcile.ReconcileConfig(keys=("okey",), compared=("status",), source_of={"status": "st"}, source_keys=("skey",), geometry="geom")
_KINDS = """(select o_orderkey as o, o_orderstatus as st, o_orderkey % 12 as kind, cast(o_orderkey as varchar) as key from orders) q"""


def shaped_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(okey, status, geom, rec) and (skey, st, geom, rec). Kind 9 has two rows on both sides, whose neighbours are the other way
    round; kind 10 stands in the source only."""
    o, kind = F.col("o_orderkey"), F.col("o_orderkey") % 12
    orders = table(spark, sf_dir, "orders").select(o, F.col("o_orderstatus").alias("st"), (o % 500).alias("x"), (o % 700).alias("y"), kind.alias("kind"))

    def square(corners: str, dx=0.0) -> Column:
        """A square of side 3 whose corners stand in the order given, moved along x."""
        at = {"a": (0, 0), "b": (3, 0), "c": (3, 3), "d": (0, 3)}
        said = [F.concat((F.col("x") + F.lit(dx) + at[c][0]).cast("string"), F.lit(" "), (F.col("y") + at[c][1]).cast("string")) for c in corners]
        return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *said), F.lit("))"))

    k = F.col("kind")
    target = orders.where("kind <> 10").select(o.alias("okey"), "st", square("abcda").alias("geom"), o.alias("rec"), "kind")
    target = target.unionByName(orders.where("kind = 9").select(o.alias("okey"), "st", square("abcda", 10.0).alias("geom"), (o + 600000000).alias("rec"), "kind"))
    geom = (
        F.when(k == 1, square("cdabc")).when(k == 2, square("dcbad")).when(k == 3, square("abcda", 0.01)).when(k == 4, square("abcda", 0.00001)).when(k == 5, F.lit(None))
        .when(k == 6, square("abaa")).when(k == 8, square("abcda", 0.5)).when(k == 9, square("abcda", 9.0)).when(k == 11, square("abcda", 0.0002)).otherwise(square("abcda"))
    )
    st = F.when(k.isin(7, 8), F.concat(F.col("st"), F.lit("!"))).otherwise(F.col("st"))
    source = orders.select(o.cast("string").alias("skey"), st.alias("st"), geom.alias("geom"), o.alias("rec"))
    source = source.unionByName(orders.where("kind = 9").select(o.cast("string").alias("skey"), F.lit("?").alias("st"), square("abcda", 1.0).alias("geom"), (o + 600000000).alias("rec")))
    return target.select("okey", F.col("st").alias("status"), "geom", "rec"), source


@query(f"""select key, case when kind in (0, 1, 2, 4, 11) then 'MATCH' when kind in (3, 5, 8) then 'GEOMETRY_MISMATCH' when kind = 7 then 'ATTRIBUTE_MISMATCH' when kind = 10 then 'ONLY_IN_SHP' end as type,
  case when kind in (7, 8) then 'status' when kind = 10 then null else '' end as changed, case when kind <> 10 then o end as db_rec, o as file_rec from {_KINDS} where kind not in (6, 9)
union all select key, 'ONLY_IN_DB', null, o, null from {_KINDS} where kind = 6
union all select key, 'DEGENERATE', null, null, o from {_KINDS} where kind = 6
union all select key, 'GEOMETRY_MISMATCH', 'status', o, o + 600000000 from {_KINDS} where kind = 9
union all select key, 'GEOMETRY_MISMATCH', '', o + 600000000, o from {_KINDS} where kind = 9""")
def x01_reconcile_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison with geometry: equal shapes however they are written, small moves within the tolerance, nearest rows of a
    repeated key, missing and collapsed shapes."""
    found = reconcile.items(*shaped_sides(spark, sf_dir), SHAPED)
    return found.select("key", "type", F.array_join(F.transform("differences", lambda d: d.field), ",").alias("changed"), "db_rec", "file_rec")


@query(f"""with c as (select case when kind in (0, 1, 2, 4, 11) then 'MATCH' when kind in (3, 5, 8, 9) then 'GEOMETRY_MISMATCH' when kind = 7 then 'ATTRIBUTE_MISMATCH' when kind = 10 then 'ONLY_IN_SHP' else 'ONLY_IN_DB' end as type, case when kind = 9 then 2 else 1 end as n from {_KINDS}
  union all select 'DEGENERATE', 1 from {_KINDS} where kind = 6)
select {", ".join(f"cast(coalesce(sum(n) filter (type = '{t}'), 0) as bigint) as n_{t.lower()}" for t in reconcile.TYPES)}, cast(sum(n) as bigint) as n_total,
  (select cast(sum(case kind when 10 then 1 when 9 then 4 else 2 end) as bigint) from {_KINDS}) as n_rows from c""")
def a01_shapes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both sides are accounted for, collapsed ones included."""
    return reconcile.summary(reconcile.items(*shaped_sides(spark, sf_dir), SHAPED))


@query(f"""with q as (select * from {_KINDS})
select key, 'UPDATE' as verb, kind in (7, 8) as sets_status, kind in (3, 8) as sets_geometry from q where kind in (3, 7, 8)
union all select key, 'UPDATE', true, true from q where kind = 9
union all select key, 'UPDATE', false, true from q where kind = 9
union all select key, 'INSERT', true, true from q where kind = 10""")
def k01_shape_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with geometry: which statements there are and what they set. A shape that the source lacks is never set."""
    target, source = shaped_sides(spark, sf_dir)
    patches = reconcile.sql_patches(reconcile.items(target, source, SHAPED), target, source, "orders", SHAPED, 32721, 4326, True)
    shape = r"ST_Multi\(ST_Transform\(ST_GeomFromText\('POLYGON\(\([0-9., E-]+\)\)', 32721\), 4326\)\)"
    said = F.col("statement")
    verb = F.substring_index(said, " ", 1)
    return patches.select("key", verb.alias("verb"), (said.contains('"status"')).alias("sets_status"), said.rlike(shape).alias("sets_geometry"))


_ADDRESSES = """(select concat(n_name, '|', c_mktsegment, '|', cast(cast(floor(c_acctbal / 100) as bigint) as varchar)) as match_key, 'site:' || c_custkey as urn, c_custkey as k, c_mktsegment as seg,
  case c_custkey % 7 when 0 then 'CADASTRE' when 1 then 'FIELD' when 2 then 'MANUAL' else 'IMPORT' end as source, c_custkey % 11 = 3 as matched, c_custkey % 5 = 2 as has_units from customer join nation on c_nationkey = n_nationkey where c_nationkey % 3 <> 1)"""
_VERDICTS = f"""with r as (select match_key, urn, k, source, matched, has_units, source in ('IMPORT', 'FIELD') as rem, source = 'CADASTRE' as prot from (select concat(split_part(match_key, '|', 1), '|', seg, '|', cast(cast(floor(cast(split_part(match_key, '|', 3) as double) / 20) as bigint) as varchar)) as match_key, urn, k, source, matched, has_units from {_ADDRESSES})),
g as (select match_key, count(*) as n_group, count(*) filter (rem and matched) as n_matched, bool_or(prot) as p, min(k) filter (rem) as least from r group by 1),
b as (select r.*, n_group, n_matched, case when prot then 'PROTECTED_SOURCE' when matched then 'INFRA_MATCHED' when n_group = 1 then 'NO_DUPLICATE' {{extra}}
  when rem and n_matched = 0 and k = least then case when p then 'KEPT_ALONGSIDE_PROTECTED' else 'LOWEST_URN_KEPT' end when n_matched > 0 then 'REDUNDANT_WITH_MATCHED' else 'REDUNDANT_NOT_LOWEST_URN' end as why from r join g using (match_key)),
d as (select *, case when rem and has_units and why like 'REDUNDANT%' then 'HAS_INTERNAL_UNITS' else why end as reason from b),
e as (select *, case when reason like 'REDUNDANT%' then 'REMOVE' else 'KEEP' end as decision from d),
o as (select match_key, row_number() over (order by match_key) as group_id from (select distinct match_key from e where decision = 'REMOVE' or reason in ('KEPT_ALONGSIDE_PROTECTED', 'HAS_INTERNAL_UNITS')))
select group_id, match_key, urn, source, n_group, n_matched, reason, decision from e join o using (match_key)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_nationkey % 3 <> 1").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    key = F.concat("n_name", F.lit("|"), "c_mktsegment", F.lit("|"), F.floor(F.floor(F.col("c_acctbal") / 100) / 20).cast("string"))
    source = F.when(k % 7 == 0, "CADASTRE").when(k % 7 == 1, "FIELD").when(k % 7 == 2, "MANUAL").otherwise("IMPORT")
    return rows.select(key.alias("match_key"), F.concat(F.lit("site:"), k.cast("string")).alias("urn"), source.alias("source"), (k % 11 == 3).alias("matched"), (k % 5 == 2).alias("has_units"))


@query(_VERDICTS.format(extra=""))
def x04_address_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate addresses in the order of the rules: sources, infrastructure, lowest URN, units inside; the groups to show, numbered."""
    found = dedup.reported(dedup.decide_by_source(addresses(spark, sf_dir), ["IMPORT", "FIELD"], ["CADASTRE"]))
    return found.select("group_id", "match_key", "urn", "source", "n_group", "n_matched", "reason", "decision")


@query(_VERDICTS.format(extra="when rem and p then 'REDUNDANT_WITH_PROTECTED'"))
def x04_verdicts_beside_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a removable row beside a protected one goes."""
    found = dedup.reported(dedup.decide_by_source(addresses(spark, sf_dir), ["IMPORT", "FIELD"], ["CADASTRE"], True))
    return found.select("group_id", "match_key", "urn", "source", "n_group", "n_matched", "reason", "decision")
