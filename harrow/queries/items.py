"""Items, tickets and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch, fields, items, lookups, prefixes
from .registry import query

_OP = "case event_type when 'view' then 'claim' when 'click' then 'commit' when 'purchase' then 'ack' when 'error' then 'fail' else 'release' end"


@query(f"""
with recursive e as (select user_id, event_id // 7 as item, {_OP} as op, 'w' || (user_id % 3) as worker, row_number() over (partition by event_id // 7 order by event_id) as n from events),
fold as (
  select item, 0::bigint as n, 'pending' as claim_state, 'staged' as durability_state, '' as worker, 0 as attempts, false as success, 0 as refused from (select distinct item from e)
  union all
  select f.item, e.n,
    case when op = 'claim' and not final and not (f.claim_state = 'claimed' and f.worker <> e.worker) then 'claimed' when op = 'commit' and not final then 'committed' when op = 'fail' and not final then 'failed' when op = 'ack' and f.durability_state = 'durable' then 'acked' when op = 'release' and f.claim_state = 'claimed' and f.worker = e.worker and f.durability_state <> 'durable' then 'pending' else f.claim_state end,
    case when op in ('commit', 'fail') and not final then 'durable' else f.durability_state end,
    case when (op in ('commit', 'fail') and not final) or (op = 'claim' and not final and not (f.claim_state = 'claimed' and f.worker <> e.worker)) then e.worker when op = 'release' and f.claim_state = 'claimed' and f.worker = e.worker and f.durability_state <> 'durable' then '' else f.worker end,
    f.attempts + (op = 'claim' and not final and not (f.claim_state = 'claimed' and f.worker <> e.worker))::int,
    case when op = 'commit' and not final then true when op = 'fail' and not final then false else f.success end,
    f.refused + ((op = 'claim' and not final and f.claim_state = 'claimed' and f.worker <> e.worker) or (op = 'ack' and f.durability_state <> 'durable'))::int
  from (select *, durability_state = 'durable' or claim_state in ('committed', 'acked', 'failed') as final from fold) f join e on e.item = f.item and e.n = f.n + 1
)
select item, claim_state, durability_state, worker, attempts, success, refused from fold where (item, n) in (select (item, max(n)) from e group by item)""")
def item_replay(load):
    log = load("events").select(F.expr("event_id div 7").alias("item"), F.expr(_OP).alias("op"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("by"), "event_id")
    return items.replay(log, "item", "op", "by", ["event_id"])


@query("select greatest(coalesce(min(p) filter (not known), max(p) + 1) - 1, min(p)) as page from (select l_linenumber as p, min_by(l_partkey, l_orderkey * 1000000 + l_partkey) in (select l_partkey from lineitem where l_returnflag = 'R') as known from lineitem group by 1)")
def resume_page(load):
    lines = load("lineitem")
    pos = (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("pos")
    return items.resume_page(lines.select("l_linenumber", pos, "l_partkey"), lines.where("l_returnflag = 'R'"), "l_linenumber", "pos", "l_partkey")


@query("select user_id, string_agg(event_type, ',' order by event_id) as actions from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 5 group by 1")
def recent_actions(load):
    return items.recent(load("events"), "user_id", [F.col("event_id")], 5, F.col("event_type")).select("user_id", F.array_join("actions", ",").alias("actions"))


@query("select n_regionkey, r_regionkey || ':' || (row_number() over (partition by n_regionkey order by n_name) - 1) as ticket, n_name as payload, 'queued' as status from nation join region on n_regionkey = r_regionkey")
def spawn_tickets(load):
    kids = load("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("kids")).withColumn("ticket", F.col("n_regionkey").cast("string"))
    return dispatch.spawn(kids, "ticket", "kids", "n_regionkey").select("n_regionkey", "ticket", "payload", "status")


@query("""
with c as (select l_orderkey, '/x/' || (l_partkey % 4) as x, l_linenumber as pos, l_suppkey from lineitem),
p as (select l_orderkey, x, min(pos * 100000 + l_suppkey) as p from c group by all)
select l_orderkey, string_agg(x, ',' order by p, x) filter (n <= 3) as xpaths from (select *, row_number() over (partition by l_orderkey order by p, x) as n from p) group by 1""")
def capped_candidates(load):
    rows = load("lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("p"), F.concat(F.lit("/x/"), (F.col("l_partkey") % 4).cast("string")).alias("x"))
    lists = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("all"))
    out = fields.capped_candidates(F.get("all", F.lit(0)), F.col("all"), 3)
    return lists.select("l_orderkey", F.array_join(F.transform(out, lambda s: s["xpath"]), ",").alias("xpaths"))


@query("""
with c as (select l_orderkey, case l_returnflag when 'A' then '//*[@id="a"]' when 'N' then '/n[1]' else '/r' end as x, l_extendedprice as pos, l_linestatus = 'O' as ok, case l_returnflag when 'A' then 3.5 when 'N' then -0.2 else 0.0 end as s from lineitem),
o as (select *, row_number() over (partition by l_orderkey, x order by pos) as k from c)
select l_orderkey, x as xpath from (select *, row_number() over (partition by l_orderkey order by s desc, pos) as n from o where k = 1 and ok) where n = 1""")
def best_verified(load):
    x = F.when(F.col("l_returnflag") == "A", '//*[@id="a"]').when(F.col("l_returnflag") == "N", "/n[1]").otherwise("/r")
    rows = load("lineitem").select("l_orderkey", x.alias("x"), F.col("l_extendedprice").alias("pos"), (F.col("l_linestatus") == "O").alias("ok"))
    return fields.best_verified(rows, "l_orderkey", "x", "pos", F.col("ok")).select("l_orderkey", F.col("x").alias("xpath"))


@query("select p_brand as name, 0 as source, min(p_partkey) as pos from part where p_size < 20 group by 1 union all select p_brand, 1, min(p_partkey) from part where p_brand not in (select p_brand from part where p_size < 20) group by 1")
def field_items(load):
    parts = load("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("pos"), "p_size")
    return fields.field_items([parts.where("p_size < 20"), parts], "name").select("name", "source", "pos")


@query("select l_orderkey, l_linenumber, l_returnflag <> 'N' and l_partkey not in (select l_partkey from lineitem where l_quantity > 49) as validated from lineitem")
def mark_failed(load):
    rows = load("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_returnflag") != "N", "/x").otherwise("").alias("xpath"))
    failed = load("lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("name"))
    return fields.mark_failed(rows, failed, "name", "xpath").select("l_orderkey", "l_linenumber", "validated")


@query("select event_type, sum(cast(floor(value) as bigint)) filter (user_id % 2 = 0) as total, count(*) filter (user_id % 2 <> 0)::bigint as timings from events group by 1")
def metrics(load):
    rows = load("events").select("event_type", F.when(F.col("user_id") % 2 == 0, "counter").otherwise("timing").alias("kind"), F.floor("value").alias("v"), "event_id")
    return fields.metrics(rows, "event_type", "kind", "v", "event_id").select("event_type", "total", F.size("timings").cast("long").alias("timings"))


@query("""
with t as (select n_nationkey, n_regionkey, lower(replace(n_name, ' ', '')) as a from nation), m as (select n_nationkey as mark, n_regionkey, lower(replace(n_name, ' ', '')) as b from nation),
p as (select t.n_nationkey, mark, (select count(*) from range(1, 40) r(i) where i <= least(length(a), length(b)) and substr(a, 1, i::int) = substr(b, 1, i::int)) as shared, a from t join m on t.n_regionkey = m.n_regionkey)
select n_nationkey, mark, shared from (select *, max(shared) over (partition by n_nationkey) as most from p where shared >= greatest(1, ceil(length(a) * 0.4))) where shared = most""")
def longest_prefix(load):
    n = load("nation")
    marks = n.select("n_regionkey", F.col("n_nationkey").alias("mark"), F.col("n_name").alias("mark_text"))
    found = lookups.longest_prefix(n.select("n_nationkey", "n_regionkey", F.replace("n_name", F.lit(" "), F.lit("")).alias("text")), marks, "n_regionkey", "text", "mark_text", "mark", least=1)
    return found.select("n_nationkey", "mark", F.col("shared").cast("long").alias("shared"))


@query("""
with t as (select doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) as a from documents),
m as (select item_id, lower(regexp_replace(text, '\\s+', '', 'g')) as b from benchmark),
s as (select doc_id, item_id, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))), 0) as shared from t, m where a <> '' and b <> '')
select doc_id, shared::integer as shared, count(*) as marks, min(item_id) as mark from s
where shared >= 1 and shared = (select max(shared) from s x where x.doc_id = s.doc_id) group by all""")
def shared_beginnings(load):
    """For each document the benchmark items that begin most like it."""
    return prefixes.longest_shared(load("documents"), load("benchmark"), "doc_id", "text", "item_id", "text", least=1, share=0.0)
