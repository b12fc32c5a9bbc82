"""Run history, merges, roll-ups: customers stand for tasks, orders for runs, lines for items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcomes
from ..operators import history as H
from ..operators import merge, rollup
from .registry import query

DAY = "strftime({}, '%Y-%m-%d')"


@query("""
select c_custkey, c_name, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as started_at from customer join (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'F'
) on c_custkey = o_custkey where n = 1""")
def latest_reusable_run(load):
    tasks = load("customer").withColumnRenamed("c_custkey", "o_custkey")
    found = H.latest_reusable(tasks, load("orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "F")
    return found.select(F.col("o_custkey").alias("c_custkey"), "c_name", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"))


@query("select o_orderkey, o_custkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n <= 3")
def recent_runs_per_task(load):
    return H.latest(load("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
select c_custkey, o_orderkey from (select * from customer order by c_acctbal desc, c_custkey limit 100) join (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'F'
) on c_custkey = o_custkey where n = 1""")
def limit_then_reusable(load):
    tasks = load("customer").withColumnRenamed("c_custkey", "o_custkey")
    found = H.recent_then_reusable(tasks, load("orders"), "o_custkey", "c_acctbal", "o_orderdate", "o_orderkey", "o_orderstatus", "F")
    return found.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query("""
select o_orderkey, count(l_orderkey) as n_items, count(*) filter (l_returnflag = 'R') as n_failures from orders left join lineitem on o_orderkey = l_orderkey group by 1""")
def run_detail_nested(load):
    runs = load("orders").select(F.col("o_orderkey").alias("run"))
    lines = load("lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_partkey", "l_returnflag")
    nested = H.detail(runs, lines, lines.where("l_returnflag = 'R'"), "run", "l_linenumber")
    return nested.select(F.col("run").alias("o_orderkey"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.size("validation_failures"), F.lit(0)).cast("long").alias("n_failures"))


@query("""
select l_partkey, l_orderkey, l_linenumber, conflict from (
  select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) > 1 as conflict from lineitem join orders on l_orderkey = o_orderkey
  where l_linestatus = 'O' and l_returnflag in ('A', 'N') and o_orderstatus in ('O', 'F'))""")
def eligible_items_dedup(load):
    items = load("lineitem").join(load("orders").where(F.col("o_orderstatus").isin("O", "F")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    durable = F.when(F.col("l_linestatus") == "O", "durable")
    claim = F.when(F.col("l_returnflag") == "A", "acked").when(F.col("l_returnflag") == "N", "committed").otherwise("failed")
    good = items.where(outcomes.eligible(F.lit(True), durable, claim)).withColumn("url", F.col("l_partkey").cast("string"))
    return rollup.first_wins(good, "url", [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber", "conflict")


@query("""
select l_orderkey, count(*) as total, count(*) filter (l_returnflag <> 'R') as success_count, count(*) filter (l_returnflag = 'R') as failed_count,
  round(count(*) filter (l_returnflag <> 'R') / count(*), 4) as success_rate, bool_and(l_linestatus = 'O') as durable from lineitem group by 1""")
def run_rollup(load):
    return rollup.summary(load("lineitem"), ["l_orderkey"], F.col("l_returnflag") != "R", F.col("l_linestatus") == "O")


@query("""
with r as (select o_orderkey, o_orderstatus, count(l_orderkey) as total, count(*) filter (l_returnflag <> 'R') as good from orders left join lineitem on o_orderkey = l_orderkey group by all)
select o_orderkey,
  case when o_orderstatus = 'P' and total % 5 = 4 then 'interrupted' when o_orderstatus = 'P' and total % 5 = 3 then 'failed' else 'completed' end as execution_state,
  case when o_orderstatus = 'P' and total % 5 = 4 then 'interrupted' when o_orderstatus = 'P' and total % 5 = 3 then 'system_failure' when total = 0 then 'no_data' when good = total then 'success' else 'partial_success' end as outcome_state,
  case when o_orderstatus = 'P' and total % 5 = 4 then 'rejected' when o_orderstatus = 'P' and total % 5 = 3 then case when good > 0 then 'diagnostic_only' else 'rejected' end when total = 0 then 'rejected' when good = total then 'reusable' when good > 0 then 'diagnostic_only' else 'rejected' end as promotion_state,
  case when total > 0 then round(good / total, 4) else 0.0 end as success_rate
from r""")
def run_classification(load):
    runs = load("orders").join(load("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = runs.groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("good"))
    partial = F.col("o_orderstatus") == "P"
    reason = F.when(partial & (F.col("total") % 5 == 4), "browser_intervention")
    error = F.when(partial & (F.col("total") % 5 == 3), "broken")
    out = n.withColumn("x", outcomes.run_outcome(F.col("total"), F.col("good"), error, F.lit(0), reason))
    return out.select("o_orderkey", "x.execution_state", "x.outcome_state", "x.promotion_state", "x.success_rate")


@query("""
select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as "n_F", count(*) filter (o_orderstatus = 'O') as "n_O", count(*) filter (o_orderstatus = 'P') as "n_P", bool_and(o_orderstatus in ('F', 'O')) as complete from orders group by 1""")
def status_progress(load):
    return rollup.status_counts(load("orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"], ["F", "O"])


@query("""
select user_id, count(*) filter (event_type <> 'error') as success_count, count(*) filter (event_type = 'error') as failure_count,
  strftime(max(ts) filter (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') as last_success, strftime(max(ts) filter (event_type = 'error'), '%Y-%m-%d %H:%M:%S') as last_failure
from events group by 1""")
def path_counters(load):
    n = merge.counters(load("events"), ["user_id"], F.col("event_type") != "error", "ts")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return n.select("user_id", "success_count", "failure_count", stamp("last_success_at").alias("last_success"), stamp("last_failure_at").alias("last_failure"))


@query("""
select user_id, event_type, success_count, rank from (
  select *, row_number() over (partition by user_id order by success_count desc, event_type) as rank from (select user_id, event_type, count(*) as success_count from events where event_type <> 'error' group by all having count(*) >= 2)) where rank <= 8""")
def xpath_stat_ranking(load):
    n = load("events").where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count("*").alias("success_count")).where("success_count >= 2")
    top = n.withColumn("rank", F.row_number().over(H.Window.partitionBy("user_id").orderBy(F.col("success_count").desc(), "event_type")))
    return top.where("rank <= 8")


@query("""
select o_orderkey, case when o_orderkey % 2 = 1 and o_orderkey % 12 <> 1 then 'late' else o_orderstatus end as o_orderstatus, case when o_orderkey % 2 = 1 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders""")
def upsert_last_nonempty(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    known = orders.where("o_orderkey % 4 <> 3")  # the others are new
    incoming = orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.when(F.col("o_orderkey") % 12 == 1, "").otherwise("late").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge.upsert(known, incoming, ["o_orderkey"], [F.col("o_totalprice")], keep=("o_orderstatus",))


@query("""
select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 3 <> 0 union all select l_orderkey, l_linenumber, l_quantity * 2 from lineitem where l_orderkey % 3 = 0 and l_linenumber = 1
union all select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 3 = 0 and l_orderkey not in (select l_orderkey from lineitem where l_orderkey % 3 = 0 and l_linenumber = 1)""")
def replace_children(load):
    lines = load("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    incoming = lines.where("l_orderkey % 3 = 0 and l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") * 2)
    return merge.replace_children(lines, incoming, "l_orderkey")


@query("""
with r as (select l_suppkey, l_orderkey * 100 + l_linenumber as pos, case when l_returnflag = 'N' then '' else '/p/' || (l_partkey % 7) end as xpath, l_linestatus = 'F' and l_returnflag = 'R' as validated from lineitem),
best as (select l_suppkey, first(xpath order by not validated, pos, xpath) filter (xpath <> '') as xpath, bool_or(validated and xpath <> '') as validated from r group by 1),
rest as (select d.l_suppkey, x, row_number() over (partition by d.l_suppkey order by p, x) as n from (select l_suppkey, xpath as x, min(pos) as p from r where xpath <> '' group by all) d join best b on d.l_suppkey = b.l_suppkey and x <> b.xpath)
select b.l_suppkey, b.xpath, b.validated, coalesce(string_agg(x, ',' order by n) filter (n <= 5), '') as fallbacks from best b left join rest on b.l_suppkey = rest.l_suppkey group by all""")
def merge_fold(load):
    rows = load("lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("/p/"), (F.col("l_partkey") % 7).cast("string"))).alias("xpath"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("validated")
    )
    out = merge.fold_configs(rows, ["l_suppkey"], "pos")
    return out.select("l_suppkey", "xpath", "validated", F.array_join("fallbacks", ",").alias("fallbacks"))


@query("""
select case when l_returnflag = 'A' and l_linestatus = 'O' then 'pending' when l_returnflag = 'A' then 'claimed' else 'other' end as claim_state, l_returnflag = 'A' and l_linestatus = 'O' as released, count(*) as n from lineitem group by all""")
def resume_release(load):
    items = load("lineitem").select(F.when(F.col("l_returnflag") == "A", "claimed").otherwise("other").alias("claim_state"), F.when(F.col("l_linestatus") == "F", "durable").otherwise("staged").alias("durability_state"))
    return merge.release_for_resume(items).groupBy("claim_state", "released").agg(F.count("*").alias("n"))


@query("""
select user_id, coalesce(first(event_type order by event_id) filter (event_type in ('error', 'click')), null) as category, case when bool_or(event_type in ('error', 'click')) then 'replan' else 'aggregate' end as strategy from events group by 1""")
def feedback_strategy(load):
    return rollup.first_failure(load("events"), "user_id", "event_id", "event_type", ("error", "click"))


@query("""
select event_type, count(*) as calls, count(*) filter (value is not null) as calls_with_usage, coalesce(sum(cast(floor(value) as bigint)), 0)::bigint as prompt_tokens, coalesce(sum(length(props)), 0)::bigint as completion_tokens, coalesce(sum(cast(floor(value) as bigint) + length(props)), 0)::bigint as total_tokens from events group by 1""")
def token_usage(load):
    prompt, completion = F.floor("value").cast("long"), F.length("props").cast("long")
    return rollup.token_usage(load("events"), ["event_type"], prompt, completion, prompt + completion).withColumn("calls_with_usage", F.col("calls_with_usage"))


@query("""
select o_orderkey as "row", case when c_custkey % 3 = 0 then 2 when c_custkey % 3 = 1 then 1 end as tier, case when c_custkey % 3 < 2 then c_custkey end as task_key from orders join customer on o_custkey = c_custkey""")
def task_identity(load):
    known = load("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("normalized_url"), F.lit(None).cast("string").alias("page_state_signature"),
        F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("").alias("semantic_signature"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("none").alias("computed_signature"), F.col("c_mktsegment").alias("task_description"),
    )
    names = load("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("normalized_url"), F.col("c_mktsegment").alias("semantic_signature"))
    incoming = load("orders").join(names, "o_custkey").select(F.col("o_orderkey").alias("row"), "normalized_url", F.lit("").alias("page_state_signature"), "semantic_signature", F.lit("x").alias("task_description"))
    return H.identify(incoming, known)


@query("""
select coalesce(h.o_orderkey, c.o_orderkey) as o_orderkey, coalesce(h.place, c.place) as place from (select o_orderkey, 'hot' as place from orders where o_orderstatus = 'F') h full join (select o_orderkey, 'cold' as place from orders) c on h.o_orderkey = c.o_orderkey""")
def hot_cold_overlay(load):
    orders = load("orders")
    return H.overlay(orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("hot").alias("place")), orders.select("o_orderkey", F.lit("cold").alias("place")), "o_orderkey")


@query("""
with e as (select c_nationkey as k from customer), s as (select s_nationkey as k from supplier)
select 'union' as op, k from (select k from e union select k from s) union all select 'intersect', k from (select k from e intersect select k from s) union all select 'except', k from (select k from e except select k from s) union all select 'union_all', k from (select k from e union all select k from s)""")
def set_ops(load):
    a, b = load("customer").select(F.col("c_nationkey").alias("k")), load("supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    tagged = [rows.select(F.lit(op).alias("op"), "k") for op, rows in parts.items()]
    return tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])


@query("""
select c_custkey as registry_id, c_name as original_url, coalesce(nullif(c_mktsegment, 'BUILDING'), '') as anchor_url, coalesce(o_orderstatus, '') as status, coalesce(o_orderkey, 0) as execution_id, coalesce(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '') as updated_at, array_to_string([c_name, c_mktsegment], ',') as fields
from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'F') on c_custkey = o_custkey and n = 1""")
def registry_projection(load):
    """Customers as registry entries with their newest finished order, blanks where there is none."""
    tasks = load("customer").withColumnRenamed("c_custkey", "o_custkey")
    runs = H.latest_reusable(tasks.select("o_custkey"), load("orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "F")
    both = tasks.join(runs, "o_custkey", "left")
    out = H.projected(both, registry_id="o_custkey", original_url="c_name", anchor_url=F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), status="o_orderstatus", execution_id="o_orderkey", updated_at="o_orderdate", fields=F.array("c_name", "c_mktsegment"))
    return out.withColumn("fields", F.array_join("fields", ","))
