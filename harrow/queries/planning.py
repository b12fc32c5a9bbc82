"""Plans, states of pages, journals, rules and skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcomes, states, text, xpaths
from ..operators import dispatch, evaluate, fields, lookups, planning, rollup
from .registry import query


@query("""
with c as (select c_custkey as pos, c_nationkey as plan, case when c_custkey % 7 = 0 then '' else c_mktsegment end as name, case when c_custkey % 14 = 0 then '' else 'Link ' || (c_custkey % 3) end as link, c_mktsegment as seg, c_custkey % 4 as k from customer),
n as (select pos, plan, case when name <> '' then name else link end as name, seg, k from c where name <> '' or link <> ''),
s as (select *, case when k = 0 then 'own:' || lower(seg) else 'category:shop > ' || lower(seg) end as scope_key from n where lower(name) in ('building', 'link 1') or lower(seg) = 'building'),
f as (select *, row_number() over (partition by plan, scope_key order by pos) as r from s)
select plan, scope_key, pos, name, 'Shop > ' || seg as scope_label, 'collect: ' || name as task from f where r = 1""")
def page_fact_subtasks(load):
    k = F.col("c_custkey")
    rows = load("customer").select(
        k.alias("pos"), F.col("c_nationkey").alias("plan"), F.when(k % 7 == 0, " ").otherwise(F.col("c_mktsegment")).alias("name"), F.when(k % 14 == 0, "").otherwise(F.concat(F.lit("Link "), (k % 3).cast("string"))).alias("link_text"),
        F.array(F.lit("Shop"), "c_mktsegment").alias("path"), F.when(k % 4 == 0, F.concat(F.lit("own:"), F.lower("c_mktsegment"))).alias("scope_key"), F.lit(None).cast("string").alias("scope_label"), F.lit("").alias("task_description"),
    )
    found = planning.page_fact_subtasks(rows, ["plan"], "pos", F.array(F.lit("Building"), F.lit("LINK 1")))
    return found.select("plan", "scope_key", "pos", "name", "scope_label", F.col("task_description").alias("task"))


@query("select user_id, event_type, min(event_id) as event_id from events group by all")
def first_per_state(load):
    return planning.first_per_scope(load("events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("""
with e as (select user_id, event_id as pos, case when event_id % 5 = 0 then 'runtime_' || user_id || '_' || event_id else event_type end as entry_id, event_id % 3 as phase from events),
known as (select * replace (case when pos % 5 = 0 then '' else entry_id end as entry_id) from e where pos % 2 = 0), fresh as (select *, row_number() over (partition by user_id, entry_id, phase order by pos) as n from e where pos % 2 = 1)
select user_id, pos, entry_id, phase::varchar as phase from known union all
select user_id, pos, entry_id, phase::varchar from fresh f where n = 1 and not exists (select 1 from known k where k.user_id = f.user_id and k.entry_id = f.entry_id and k.phase = f.phase)""")
def journal_merge(load):
    e = load("events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("entry_id"), (F.col("event_id") % 3).cast("string").alias("phase"), F.lit("a").alias("action"), F.lit("").alias("created_at"))
    return planning.merge_journal(e.where("pos % 2 = 0"), e.where("pos % 2 = 1"), ["user_id"], "pos").select("user_id", "pos", "entry_id", "phase")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n <= 3")
def first_entries(load):
    return planning.first_entries(load("events"), ["user_id"], "event_type", "event_id", 3).select("user_id", "event_type", "event_id")


@query("select l_orderkey, l_returnflag as label, case when l_linenumber % 3 <> 0 then 'p' || (l_linenumber % 2) end as path, min(l_linenumber) as pos from lineitem where l_linenumber % 3 <> 0 group by all")
def artifact_dedupe(load):
    rows = load("lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("p"), (F.col("l_linenumber") % 2).cast("string"))).alias("path"), F.col("l_linenumber").alias("pos"))
    return planning.artifacts(rows, ["l_orderkey"], "label", "path", "pos")


@query("""
select l_orderkey, l_suppkey % 5 as mark, coalesce(string_agg(case when l_returnflag <> 'R' then '/m/' || l_partkey end, ' ' order by l_linenumber, '/m/' || l_partkey), '//*[@data-som-id="' || (l_suppkey % 5) || '"]') as paths from lineitem group by l_orderkey, l_suppkey % 5""")
def mark_paths(load):
    rows = load("lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("mark"), "l_linenumber", F.when(F.col("l_returnflag") != "R", F.concat(F.lit("/m/"), F.col("l_partkey").cast("string"))).alias("x"))
    return planning.mark_paths(rows, ["l_orderkey"], "mark", "x", "l_linenumber").withColumn("paths", F.array_join("paths", " "))


@query("""
with s as (select l_orderkey as run, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as pos, 'k' || (l_suppkey % 4) as path, case l_partkey % 3 when 0 then '' when 1 then 'a.org' else 'b.org' end as domain, case when l_orderkey % 2 = 0 then 'a.org' else '' end as host, l_returnflag <> 'R' as good from lineitem),
g as (select *, row_number() over (partition by run, path order by pos) as n from s where good and (host = '' or domain in ('', host))),
f as (select *, row_number() over (partition by run order by pos) as k from g where n = 1)
select run, pos, path, domain from f where k <= 2""")
def seeded_skills(load):
    part = F.col("l_partkey") % 3
    rows = load("lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("k"), (F.col("l_suppkey") % 4).cast("string")).alias("path"), F.when(part == 0, " ").when(part == 1, "a.org").otherwise("b.org").alias("domain"), "l_returnflag")
    host = F.when(F.col("run") % 2 == 0, "a.org")
    found = planning.seeded_skills(rows, ["run"], "pos", host, F.col("l_returnflag") != "R", most=2)
    return found.select("run", "pos", "path", F.trim("domain").alias("domain"))


@query("""
with s as (select o_custkey as c, 'f' || (o_orderkey % 6) as name, o_orderkey % 3 as rank, min(o_orderkey) as k from orders group by all),
u as (select s.c, name, k from s join (select c, min(rank) as rank from s group by 1) m on s.c = m.c and s.rank = m.rank)
select c, name, case when name in ('f0', 'f3') then '/own' when k % 2 = 0 then '/x' else '' end as xpath, (name in ('f0', 'f3') or k % 2 = 0) and name <> 'f0' as validated from u""")
def field_rule_build(load):
    o = load("orders").groupBy(F.col("o_custkey").alias("c"), F.concat(F.lit("f"), (F.col("o_orderkey") % 6).cast("string")).alias("name"), (F.col("o_orderkey") % 3).alias("rank")).agg(F.min("o_orderkey").alias("k"))
    sources = o.select("c", "rank", F.concat(F.lit(" "), "name").alias("name"), F.when(F.col("k") % 2 == 0, "/x").alias("xpath"))
    configs = o.where("name in ('f0', 'f3')").select("c", "name", F.lit("/own ").alias("xpath")).distinct()
    failed = o.where("name = 'f0'").select("c", "name")
    return planning.field_rules(sources, configs, failed, ["c"], "rank").select("c", "name", "xpath", "validated")


@query("select l_orderkey, bool_and(l_linenumber > 2 or l_returnflag <> 'R' or l_linestatus = 'O' or l_suppkey % 2 = 0) as ready from lineitem group by 1")
def rules_ready(load):
    ready = states.rule_ready(F.col("l_linenumber") <= 2, F.when(F.col("l_returnflag") != "R", "/x").otherwise(" "), F.when(F.col("l_linestatus") == "O", " Constant").otherwise("llm"), F.when(F.col("l_suppkey") % 2 == 0, "URL").otherwise("text"))
    return planning.rules_ready(load("lineitem"), ["l_orderkey"], ready)


@query("select c_custkey, c_custkey % 2 = 0 and c_custkey % 3 <> 0 as reusable from customer")
def reusable_config(load):
    status = F.when(F.col("c_custkey") % 2 == 0, " validated").otherwise("draft")
    return load("customer").select("c_custkey", states.reusable_config(status, F.when(F.col("c_custkey") % 3 != 0, "/a")).alias("reusable"))


@query("select event_id, user_id, c_name from events join customer on user_id = c_custkey")
def hydrated_messages(load):
    return planning.hydrate(load("events").select("event_id", "user_id"), load("customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")


@query("""
with o as (select user_id, event_type || (event_id % 40) as url, event_id % 6 as page, event_id as pos from events), f as (select *, row_number() over (partition by user_id, url order by page, pos) as n from o where page <= 3),
k as (select *, row_number() over (partition by user_id order by page, pos) as k from f where n = 1)
select user_id, url, page, pos from k where k <= 5""")
def collection_stop(load):
    rows = load("events").select("user_id", F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("url"), (F.col("event_id") % 6).alias("page"), F.col("event_id").alias("pos"))
    return planning.until(rows, ["user_id"], "page", "pos", "url", 5, 3).select("user_id", "url", "page", "pos")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'made-' || c_mktsegment when c_custkey % 3 = 1 then 'given' else '' end as semantic_signature from customer")
def signature_on_write(load):
    k = F.col("c_custkey")
    rows = load("customer").select("c_custkey", "c_mktsegment", F.when(k % 3 == 1, " given").alias("semantic_signature"))
    known = rows.where("c_custkey % 3 = 2").select("c_custkey")
    return planning.with_signature(rows, known, ["c_custkey"], k % 3 == 0, F.concat(F.lit("made-"), "c_mktsegment")).select("c_custkey", "semantic_signature")


@query("""
select event_id, case event_type when 'view' then 'scroll' when 'click' then 'retry' when 'error' then 'type' when 'signup' then case when event_id % 2 = 0 then 'navigate' else 'click' end else '' end as action from events""")
def action_names(load):
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    name = F.when(kind == "view", " Scroll_Down").when(kind == "click", "PRESS")
    args = F.create_map(F.lit("text"), F.when(kind == "error", "x"), F.lit("target_text"), F.when(kind.isin("error", "signup"), "t"), F.lit("url"), F.when((kind == "signup") & even, "https://h.org"))
    return load("events").select("event_id", states.action(name, args).alias("action"))


@query("select event_id, event_id % 4 in (1, 2) and event_id % 3 <> 0 as activated from events")
def state_activation(load):
    k = F.col("event_id") % 4
    state = lambda c, aria: F.create_map(F.lit("class_name"), c, F.lit("aria_current"), aria)
    before = state(F.when(F.col("event_id") % 3 == 0, "btn Active").otherwise("btn"), F.lit(None).cast("string"))
    after = state(F.when(k == 1, "tab is-selected").otherwise("tab"), F.when(k == 2, "Page").otherwise("false"))
    return load("events").select("event_id", states.activated(before, after).alias("activated"))


@query("select event_id, 'click' as action, case when event_id % 2 = 0 then 'Next' else '' end as target, 2::bigint as parts from events")
def stable_steps(load):
    step = F.create_map(F.lit("action"), F.lit(" CLICK "), F.lit("target_text"), F.when(F.col("event_id") % 2 == 0, " Next"), F.lit("seen_at"), F.col("ts").cast("string"))
    found = states.stable_step(step)
    return load("events").select("event_id", found["action"].alias("action"), found["target_text"].alias("target"), F.size(found).cast("long").alias("parts"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'success' when 'O' then 'expanded' else 'failed' end as status from orders")
def result_status(load):
    outcome = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.when(F.col("o_orderstatus") == "O", " Expanded").otherwise("no_data"))
    return load("orders").select("o_orderkey", states.result_status(outcome, F.lit("completed")).alias("status"))


@query("""
select event_id, event_id::varchar as page_id, 'contract_violation' as category, case when event_id % 2 = 0 then event_type else '' end as action, event_id % 3 as errors, case when event_id % 3 = 0 then 'success' when event_id % 2 = 0 then 'partial' else 'failed' end as status from events""")
def failure_records(load):
    e, even = F.col("event_id"), F.col("event_id") % 2 == 0
    errors = F.array_repeat(F.lit("bad"), (e % 3).cast("int"))
    record = states.violation(F.lit("planner"), F.when(even, F.col("event_type")), F.lit(None), F.col("props"), errors, e)
    result = states.envelope(F.when(even, e), errors, F.create_map(F.lit("value"), F.col("value")), e.cast("string"))
    return load("events").select("event_id", record["page_id"].alias("page_id"), record["category"].alias("category"), record["metadata"]["action"].alias("action"), F.size(record["metadata"]["validation_errors"]).cast("long").alias("errors"), result["status"].alias("status"))


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as at, case when o_orderkey % 5 = 0 then 1 when o_orderkey % 2 = 0 then 4 else 3 end as consumers, case when o_orderkey % 5 = 0 then 1 else greatest(case when o_orderkey % 2 = 0 then 4 else 3 end, 2) end as budget from orders""")
def times_and_limits(load):
    k = F.col("o_orderkey")
    found = states.concurrency(F.when(k % 2 == 0, 4).otherwise(-1), F.lit(2), F.lit(None).cast("int"), k % 5 == 0)
    return load("orders").select("o_orderkey", states.iso("o_orderdate").alias("at"), found["consumers"].alias("consumers"), found["budget"].alias("budget"))


@query("select p_partkey, 'category:' || lower(p_brand) || ' > ' || lower(p_type) as key, p_brand || ' > ' || p_type as label, case when p_partkey % 2 = 0 then 4 else 0 end::bigint as fields from part")
def category_scopes(load):
    own = states.scope(F.lit(" "), F.lit(None).cast("string"), F.array("p_brand", "p_type"))
    return load("part").select("p_partkey", own["key"].alias("key"), own["label"].alias("label"), F.size(states.fixed_fields(F.when(F.col("p_partkey") % 2 == 0, own["label"]))).cast("long").alias("fields"))


@query("select c_custkey, 'fi straße ' || lower(c_mktsegment) as loose from customer")
def loose_text(load):
    return load("customer").select("c_custkey", F.replace(text.normalise_loose(F.concat(F.lit("ﬁ  Stra​ße\n "), "c_mktsegment", F.lit(" "))), F.lit("ss"), F.lit("ß")).alias("loose"))


@query("""
select o_orderkey, case o_orderstatus when 'F' then 'included' when 'O' then 'failed' else 'excluded' end as eligibility, case o_orderstatus when 'F' then '' when 'O' then 'subtask_not_durable' else 'status_skipped' end as reason, o_orderstatus = 'F' as trusted from orders""")
def merge_eligibility(load):
    s = F.col("o_orderstatus")
    found = outcomes.merge_eligibility(F.lit(True), F.when(s == "P", "skipped").otherwise("completed"), F.when(s == "F", " Durable").otherwise("staged"), F.lit(True), F.lit("x1"), ["skipped"])
    return load("orders").select("o_orderkey", found["eligibility"].alias("eligibility"), found["reason"].alias("reason"), (found["reason"] == "").alias("trusted"))


@query("select p_partkey, case p_partkey % 4 when 0 then p_brand when 1 then p_type when 2 then 'https://h.org' end as value, p_partkey % 3 <> 0 as name_ok, case when p_size > 10 then p_size end as size, replace(replace(p_type, 'a', '_'), 'A', '_') as file from part")
def small_values(load):
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, "constant").when(k == 1, "subtask_context").when(k == 2, "task_url").otherwise("llm")
    value = outcomes.direct_value(source, F.col("p_brand"), F.create_map(F.lit("kind"), F.col("p_type")), F.lit("https://h.org"), F.lit("kind"))
    name = F.when(F.col("p_partkey") % 3 == 0, "price").otherwise(" The Kind ")
    size = text.positive_int(F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(-F.col("p_size")).cast("string"))
    return load("part").select("p_partkey", value.alias("value"), text.name_match(name, F.lit("kind")).alias("name_ok"), size.alias("size"), F.translate(text.safe_filename(F.translate("p_type", "aA", ":/")), "", "").alias("file"))


@query("""
with t as (select o_custkey as ticket_id, count(*) filter (o_orderstatus = 'F') as attempts from orders group by 1)
select ticket_id, case when attempts < 8 then 'queued' else 'failed' end as status, attempts from t""")
def retry_or_fail(load):
    """Customers as tickets, their finished orders as attempts."""
    rows = load("orders").groupBy(F.col("o_custkey").alias("ticket_id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("attempts"))
    return rows.select("ticket_id", dispatch.after_failure(F.col("attempts"), F.lit(8)).alias("status"), "attempts")


@query("""
select l_orderkey, count(*) filter (l_linestatus = 'F') + count(*) filter (l_linestatus = 'O' and l_returnflag = 'R') >= count(*) as done from lineitem group by 1""")
def saga_done(load):
    """Orders as sagas of their lines."""
    n = load("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("completed"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("failed"), F.count("*").alias("total"))
    return n.select("l_orderkey", rollup.saga(F.col("completed"), F.col("failed"), F.col("total")).alias("done"))


@query("""
select p_partkey, p_partkey % 3 = 0 as risky, p_partkey % 2 = 0 as suspicious from part""")
def risky_paths(load):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, "/html/body/div[2]/a").otherwise("//*[@id='x']/a")
    odd = xpaths.suspicious(F.when(k % 2 == 0, "/html/nav/a").otherwise("/html/main/p"), F.lit("text"), F.array().cast("array<string>"))
    return load("part").select("p_partkey", xpaths.risky(path).alias("risky"), odd.alias("suspicious"))


@query("select round(avg(f1), 6) as macro_f1 from (select l_returnflag as field, round(l_linenumber / 10, 6) as f1 from (select l_returnflag, max(l_linenumber) as l_linenumber from lineitem group by 1))")
def macro_field_f1(load):
    rows = load("lineitem").groupBy(F.col("l_returnflag").alias("field")).agg(F.round(F.max("l_linenumber") / 10, 6).alias("f1"))
    return evaluate.macro_f1(rows)


@query("select user_id, event_type as node, count(*)::bigint + sum(event_id % 3)::bigint as steps from events group by all")
def step_totals(load):
    first = load("events").groupBy("user_id", F.col("event_type").alias("node")).agg(F.count("*").alias("steps"))
    again = load("events").select("user_id", F.col("event_type").alias("node"), (F.col("event_id") % 3).alias("steps"))
    return fields.step_totals(first, again, ["user_id"])


@query("""
select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_orderstatus = 'O') as failed, count(*) filter (o_orderstatus = 'P') as no_data, 0::bigint as expanded, coalesce(sum(o_orderkey % 5) filter (o_orderstatus = 'F'), 0)::bigint as collected from orders group by 1""")
def dispatch_summary(load):
    s, odd = F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 1
    rows = load("orders").select("o_custkey", F.when(s == "F", " Completed").when((s == "O") & odd, "system_failure").when(s == "O", "business_failure").otherwise("no_data").alias("status"), (F.col("o_orderkey") % 5).alias("n"))
    return rollup.dispatch_summary(rows, ["o_custkey"], "status", "n")


@query("""
select c_custkey, o_orderkey, o_orderkey is not null as known from customer left join (select o_custkey, max(o_orderkey) as o_orderkey from orders where o_custkey % 3 <> 0 group by 1) on c_custkey = o_custkey""")
def last_runtime_states(load):
    states_ = load("orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return rollup.last_states(load("customer").select("c_custkey"), states_, "c_custkey", [F.col("o_orderkey").desc()]).select("c_custkey", "o_orderkey", "known")


@query("""
with i as (select l_partkey, l_returnflag <> 'R' as ok from lineitem)
select count(*) filter (ok) as items, count(distinct l_partkey) filter (ok) as unique_items, count(*) filter (ok) - count(distinct l_partkey) filter (ok) as conflicts, count(*) filter (not ok) as left_out from i""")
def merged_report(load):
    rows = load("lineitem").select(F.col("l_partkey").cast("string").alias("url"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return rollup.merged_report(rows, "url", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")], F.col("l_returnflag") != "R")


@query("""
select c_custkey, case c_custkey % 4 when 0 then true when 1 then false when 2 then true end as flag, case when c_custkey % 2 = 0 then c_custkey::double else -1.0 end as number, c_mktsegment as list, case when c_custkey % 3 = 0 then 'second' else 'first' end as chosen from customer""")
def lenient_values(load):
    k = F.col("c_custkey")
    flag = text.as_bool(F.when(k % 4 == 0, " YES").when(k % 4 == 1, "off").when(k % 4 == 3, "maybe"), F.when(k % 4 == 2, True))
    number = text.as_number(F.when(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise("n/a"), -1.0)
    one = F.create_map(F.lit("k"), F.lit("first"))
    chosen = text.first_map(F.map_filter(one, lambda a, b: k % 3 != 0), F.create_map(F.lit("k"), F.lit("second")))
    return load("customer").select("c_custkey", flag.alias("flag"), number.alias("number"), F.array_join(text.string_list(F.array(F.lit(" "), F.concat(F.lit(" "), "c_mktsegment"), F.lit(None))), ",").alias("list"), chosen["k"].alias("chosen"))


@query("""
with c as (select n_regionkey, n_name as label, n_nationkey % 4 as score, n_nationkey as pos from nation)
select n_regionkey, label, score, rank from (select *, row_number() over (partition by n_regionkey order by score desc, pos) as rank from c) where rank <= 3""")
def candidate_ranking(load):
    rows = load("nation").select("n_regionkey", F.col("n_name").alias("label"), (F.col("n_nationkey") % 4).alias("s"), F.col("n_nationkey").alias("pos"))
    twice = rows.unionByName(rows.withColumns({"label": F.concat(F.lit(" "), F.lower("label")), "s": F.lit(-1).cast("long"), "pos": F.lit(99).cast(rows.schema["pos"].dataType)}))
    return lookups.rank_candidates(twice, "n_regionkey", F.col("label"), F.col("s"), [F.col("pos")], 3).select("n_regionkey", "label", "score", F.col("rank").cast("long").alias("rank"))
