"""Evaluation, lookup joins, plan trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch, evaluate, lookups
from ..plans import tree
from .registry import query

_ACTUAL = "select o_orderkey as pos, case when o_orderkey % 11 = 0 then '' else (case when o_orderkey % 7 = 0 then o_orderkey - 1 else o_orderkey end)::varchar end as k, case when o_orderkey % 5 = 0 then 'x' else o_orderstatus end as s, case when o_orderkey % 3 = 0 then o_totalprice + 5 else o_totalprice end as price from orders where o_orderkey % 13 <> 0"
_ALIGNED = f"""
a as (select *, row_number() over (partition by nullif(k, '') order by pos) as n from ({_ACTUAL})),
e as (select o_orderkey::varchar as k, o_orderstatus as s, o_totalprice as price from orders),
m as (select a.k, a.s as a_s, e.s as e_s, a.price as a_p, e.price as e_p, case when e.k is null then 'unmatched_actual' when a.pos is null then 'unmatched_expected' else 'matched' end as status
  from a full join e on a.k = e.k and a.n = 1 and a.k <> '')"""


def _aligned(load):
    orders = load("orders")
    key = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).cast("string"))
    actual = orders.where("o_orderkey % 13 <> 0").select(
        F.col("o_orderkey").alias("pos"), key.alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")).alias("price")
    )
    expected = orders.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("price"))
    return evaluate.align(actual, expected, "k", "pos")


_STRATEGIES = {"s": "exact", "price": "numeric_tolerance"}


@query(f"""
with {_ALIGNED}, c as (select count(*) filter (status = 'matched') as matched, count(*) filter (status = 'unmatched_actual') as unmatched_actual, count(*) filter (status = 'unmatched_expected') as unmatched_expected from m),
p as (select *, coalesce(matched / nullif(matched + unmatched_actual, 0), 0) as p, coalesce(matched / nullif(matched + unmatched_expected, 0), 0) as r from c)
select matched, unmatched_actual, unmatched_expected, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from p""")
def record_alignment_prf(load):
    return evaluate.record_metrics(_aligned(load))


@query(f"""
with {_ALIGNED}, f as (select 's' as field, count(a_s) as n_actual, count(e_s) as n_expected, count(*) filter (status = 'matched' and a_s = e_s) as n_correct from m
  union all select 'price', count(a_p), count(e_p), count(*) filter (status = 'matched' and abs(a_p - e_p) <= 0.01) from m)
select *, round(n_correct / n_actual, 6) as precision, round(n_correct / n_expected, 6) as recall, round(2.0 * (n_correct / n_actual) * (n_correct / n_expected) / (n_correct / n_actual + n_correct / n_expected), 6) as f1 from f""")
def field_prf(load):
    return evaluate.field_metrics(_aligned(load), _STRATEGIES)


@query(f"with {_ALIGNED} select round(avg((a_s = e_s and abs(a_p - e_p) <= 0.01)::int), 6) as exact_match_rate from m where status = 'matched'")
def exact_match_rate(load):
    return evaluate.exact_match_rate(_aligned(load), _STRATEGIES)


@query("""
select o_custkey, array_to_string(list_filter([case when r < 0.8 then 'record_recall ' || printf('%.3f', r) || ' < 0.8' end, case when f < 0.7 then 'field_f1 ' || printf('%.3f', f) || ' < 0.7' end, case when n is null then 'steps missing' when n > 50 then 'steps ' || n || ' > 50' end], lambda x: x is not null), '; ') as reasons
from (select o_custkey, count(*) filter (o_orderstatus = 'F') / count(*) as r, count(*) filter (o_orderstatus <> 'P') / count(*) as f, case when o_custkey % 10 <> 0 then (o_custkey % 60)::int end as n from orders group by o_custkey)""")
def scenario_gate(load):
    n = load("orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("r"), (F.count_if(F.col("o_orderstatus") != "P") / F.count("*")).alias("f"))
    steps = F.when(F.col("o_custkey") % 10 != 0, (F.col("o_custkey") % 60).cast("int"))
    return n.select("o_custkey", F.array_join(evaluate.gate(F.col("r"), F.col("f"), steps), "; ").alias("reasons"))


@query("""
with m as (select d.lang, l.toxic = 1 as truth, length(d.text) > 2000 as guess from documents d join labels l on d.doc_id = l.doc_id),
c as (select lang, count(*) filter (truth and guess) as tp, count(*) filter (guess and not truth) as fp, count(*) filter (truth and not guess) as fn from m group by 1)
select lang, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) as f1 from c""")
def label_eval(load):
    both = load("documents").select("doc_id", "lang", (F.length("text") > 2000).alias("guess")).join(load("labels").select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id")
    n = both.groupBy("lang").agg(F.count_if(F.col("truth") & F.col("guess")).alias("tp"), F.count_if(F.col("guess") & ~F.col("truth")).alias("fp"), F.count_if(F.col("truth") & ~F.col("guess")).alias("fn"))
    return n.withColumns(evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query("""
with s as (select l_orderkey, list(distinct l_partkey % 20) filter (l_returnflag <> 'R') as t, list(distinct l_partkey % 20) filter (l_linestatus = 'O') as f from lineitem group by 1)
select l_orderkey, case when t is null or f is null then 0.0 else round(len(list_intersect(t, f)) / len(f), 6) end as precision, case when t is null or f is null then 0.0 else round(len(list_intersect(t, f)) / len(t), 6) end as recall from s""")
def rule_quality_overlap(load):
    part = F.col("l_partkey") % 20
    sets = load("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", part)).alias("t"), F.collect_set(F.when(F.col("l_linestatus") == "O", part)).alias("f"))
    return sets.select("l_orderkey", *[v.alias(k) for k, v in evaluate.set_quality(F.col("t"), F.col("f")).items()])


@query("""
select coalesce(b.o_custkey, a.o_custkey) as o_custkey, b.n as n_before, a.n as n_after from (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) b full join (select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1) a on a.o_custkey = b.o_custkey""")
def compare_reports(load):
    n = lambda s: load("orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return evaluate.compare(n("F"), n("O"), "o_custkey", "n")


@query("""
with n as (select r_regionkey::bigint as id, null::bigint as up, r_name as label from region union all select 1000 + n_nationkey, n_regionkey, n_name from nation),
t as (select id, up, label, 0 as depth, label as path from n where up is null union all select n.id, n.up, n.label, 1, p.label || ' > ' || n.label from n join n p on n.up = p.id)
select id, depth, path from t""")
def plan_tree(load):
    top = load("region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("up"), F.col("r_name").alias("label"))
    leaves = load("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("up"), F.col("n_name").alias("label"))
    return tree.walk(top.union(leaves), "id", "up", "label").select("id", "depth", "path")


@query("""
select n.n_nationkey, s.j as siblings, len(s.names) >= 2 as switches from nation n join (select n_regionkey, list_sort(list(distinct n_name)) as l, array_to_string(list_sort(list(distinct n_name)), ',') as names from nation group by 1) x on n.n_regionkey = x.n_regionkey join (select n_regionkey, array_to_string(list_sort(list(distinct n_name)), ',') as j, list_sort(list(distinct n_name)) as names from nation group by 1) s on s.n_regionkey = n.n_regionkey""")
def sibling_registry(load):
    sets = tree.sibling_sets(load("nation"), "n_regionkey", "n_name")
    both = load("nation").join(sets, "n_regionkey")
    return both.select("n_nationkey", F.array_join("siblings", ",").alias("siblings"), tree.switches_sibling(F.col("siblings"), F.col("n_name"), F.col("siblings")).alias("switches"))


@query("select c.c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def anti_join_new(load):
    known = load("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.new_only(load("customer").select("c_custkey"), known, "c_custkey")


@query("select n_nationkey, coalesce(nullif(case when n_nationkey % 2 = 0 then n_name else '' end, ''), r_name) as steps from nation join region on n_regionkey = r_regionkey")
def parent_inherit(load):
    rows = load("nation").select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_regionkey").alias("up"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("steps"))
    roots = load("region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("up"), F.col("r_name").alias("steps"))
    return lookups.inherit(rows.union(roots), "id", "up", "steps").where("up is not null").select((F.col("id") - 1000).alias("n_nationkey"), "steps")


@query("""
with c as (select l_orderkey, 'v' || (l_partkey % 5) as v, l_quantity as score, l_linenumber as pos from lineitem),
f as (select *, row_number() over (partition by l_orderkey order by score desc, pos, v) as n from c),
b as (select l_orderkey, v, score from f where n = 1),
o as (select c.l_orderkey, max(c.score) as second from c join b on c.l_orderkey = b.l_orderkey where c.v <> b.v group by 1)
select b.l_orderkey, b.v, b.score from b left join o on b.l_orderkey = o.l_orderkey where b.score >= 0 and (second is null or b.score - second >= 1.0)""")
def best_candidate(load):
    rows = load("lineitem").select("l_orderkey", F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string")).alias("v"), "l_quantity", F.col("l_linenumber").alias("pos"))
    return lookups.best_candidate(rows, "l_orderkey", "v", F.col("l_quantity"), "pos").select("l_orderkey", "v", "score")


@query("""
with t as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 when l_linestatus = 'O' then 2 end as tier from lineitem)
select l_orderkey, l_linenumber, tier from (select *, row_number() over (partition by l_orderkey order by tier, l_linenumber) as n from t where tier is not null) where n = 1""")
def tiered_cascade(load):
    tier = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "O", 2)
    return lookups.tiered(load("lineitem"), "l_orderkey", tier, "l_linenumber").select("l_orderkey", "l_linenumber", "tier")


@query("""
with n as (select l_orderkey, count(*) filter (l_returnflag = 'R') as a, min(l_linenumber) filter (l_returnflag = 'R') as x, count(*) filter (l_linestatus = 'O') as b, min(l_linenumber) filter (l_linestatus = 'O') as y from lineitem group by 1)
select l_orderkey, case when a = 1 then 'tier_0' when a > 1 then 'ambiguous' when b = 1 then 'tier_1' when b > 1 then 'ambiguous' else 'not_found' end as status, case when a = 1 then x when a = 0 and b = 1 then y end as l_linenumber from n""")
def mark_resolution(load):
    return lookups.unique_tier(load("lineitem"), "l_orderkey", [F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"], "l_linenumber")


@query("select event_id, ts from events order by ts desc, event_id desc limit 1000")
def trimmed_stream(load):
    """The newest thousand events, as a trimmed stream keeps them."""
    return dispatch.trim(load("events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 1000)


@query("""
select c_custkey, case when c_acctbal > 0 then c_name else c_mktsegment end as url, coalesce(n, 0) as links, case when coalesce(n, 0) = 0 then 'list_page' else 'category' end as page_type
from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey""")
def page_models(load):
    """Customers as nodes of a plan, their orders as subtasks."""
    orders = load("orders").select(F.col("o_custkey").alias("c_custkey"))
    has = orders.distinct().withColumn("has", F.lit(True))
    nodes = load("customer").join(has, "c_custkey", "left").withColumn("own", F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" "))
    return tree.page_models(nodes, orders, "c_custkey", F.col("has").isNull(), "own", "c_mktsegment")
