"""Field rules and evidence; more scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcomes, text, urls
from ..operators import fields, history, votes
from .registry import query


@query("select user_id, max(value) filter (event_type = 'view') as v, max(n) as n from (select user_id, event_type, arg_max(value, event_id) as value, count(*) over (partition by user_id) as n from events group by user_id, event_type) group by 1")
def item_payload(load):
    items = fields.item_payload(load("events"), ["user_id"], "event_type", "value", "event_id")
    return items.select("user_id", F.try_element_at("item", F.lit("view")).alias("v"), F.size("item").cast("long").alias("n"))


@query("""
select l_orderkey, l_linenumber, case when l_returnflag = 'A' then 'valid' when l_linestatus = 'O' and l_returnflag = 'N' then 'valid' when l_linenumber = 1 then 'missing_required' else 'missing_optional' end as bucket from lineitem""")
def field_partition(load):
    rows = load("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "/x").otherwise("").alias("xpath"), (F.col("l_linenumber") == 1).alias("required"), F.lit("extract").alias("source"), F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "url").otherwise("text").alias("data_type"))
    return fields.prepare(rows).select("l_orderkey", "l_linenumber", "bucket")


@query("select l_orderkey, bool_and(l_linenumber <> 1 or l_returnflag <> 'R') as valid from lineitem group by 1")
def complete_samples(load):
    rows = load("lineitem").withColumn("x", F.when(F.col("l_returnflag") != "R", "/x"))
    return fields.complete_samples(rows, "l_orderkey", F.col("l_linenumber") == 1, "x", "x")


@query("""
with s as (select l_orderkey, array_to_string(list_transform(list_sort(list({'f': 'f' || l_linenumber, 'x': '/a/' || l_returnflag})), lambda s: s.f || ':' || s.x), '|') as template, min(l_partkey) as p from lineitem group by 1),
r as (select *, row_number() over (partition by template order by p, l_orderkey) as n, count(*) over (partition by template) as size from s)
select l_orderkey, case when size < 3 then 'waiting' when n <= 3 then 'explore' when n <= 7 then 'validate' else 'extract' end as role from r""")
def template_groups(load):
    rows = load("lineitem").select("l_orderkey", "l_partkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("f"), F.concat(F.lit("/a/"), "l_returnflag", F.lit("[3]")).alias("x"))
    return fields.template_groups(rows, "l_orderkey", "f", "x", "l_partkey", 3, 4).select("l_orderkey", "role")


@query("select user_id, event_type, max(event_id) as event_id from events where event_type <> 'error' and event_id % 3 <> 0 group by all")
def merge_profiles(load):
    rows = load("events").withColumns({"ok": F.col("event_type") != "error", "x": F.when(F.col("event_id") % 3 != 0, "/x").otherwise(" "), "u": F.col("user_id").cast("string")}).withColumn("x", F.trim("x"))
    return fields.merge_profiles(rows, ["u", "event_type"], "event_id", "x", "ok").select("user_id", "event_type", "event_id")


@query("""
with o as (select n_name as f, case when n_nationkey % 4 = 0 then '' else '/old' end as x, n_nationkey % 3 = 0 as v from nation where n_nationkey < 20), n as (select n_name as f, case when n_nationkey % 5 = 0 then '' else '/new' end as x, n_nationkey % 2 = 0 as v from nation where n_nationkey > 4),
b as (select coalesce(o.f, n.f) as f, o.x as ox, n.x as nx, coalesce(o.v, false) as ov, coalesce(n.v, false) as nv from o full join n on o.f = n.f),
m as (select *, case when coalesce(ox, '') <> '' and (coalesce(nx, '') = '' or (ov and not nv)) then ox else coalesce(nullif(nx, ''), ox) end as x from b)
select f, x, ov or nv as v, array_to_string(list_filter([nx, ox], lambda y: coalesce(y, '') <> '' and y <> x), ',') as rest from m""")
def merge_documents(load):
    n, none = load("nation"), F.array().cast("array<string>").alias("r")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("f"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise("/old").alias("x"), (F.col("n_nationkey") % 3 == 0).alias("v"), none)
    new = n.where("n_nationkey > 4").select(F.col("n_name").alias("f"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise("/new").alias("x"), (F.col("n_nationkey") % 2 == 0).alias("v"), none)
    return fields.merge_documents(old, new, "f", "x", "v", "r").select("f", "x", "v", F.array_join("r", ",").alias("rest"))


@query("select l_orderkey, case when count(*) >= 2 and count(distinct l_returnflag) = 1 then '/a/' || min(l_returnflag) end as xpath from lineitem group by 1")
def unanimous_path(load):
    rows = load("lineitem").select("l_orderkey", F.concat(F.lit("/a/"), "l_returnflag", F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("x"))
    return fields.unanimous(rows, "l_orderkey", "x")


@query("select c_custkey, c_mktsegment as expected, case when c_custkey % 4 = 0 then 'other' when c_custkey % 4 <> 1 then ' ' || upper(c_mktsegment) end as actual from customer where c_custkey % 4 in (0, 1)")
def value_disagreements(load):
    rows = load("customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    second = rows.where("c_custkey % 4 <> 1").withColumn("v", F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("v"))))
    return fields.disagreements(rows, second, ["c_custkey"], "v")


@query("select user_id, event_type as node, count(*)::bigint as steps from events group by all")
def step_counts(load):
    return fields.step_counts(load("events").withColumn("m", F.create_map("event_type", F.lit(1))), ["user_id"], "m")


@query("""
select user_id, event_type as profile from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'error') where n = 1""")
def first_profile(load):
    rows = load("events").withColumns({"own": F.when(F.col("event_type").isin("error", "click"), " ").otherwise(F.col("event_type")), "nested": F.when(F.col("event_type") == "click", F.col("event_type")).otherwise("")})
    return history.first_profile(rows, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], "own", "nested")


@query("""
select n_nationkey, b.pre as shared, b.pre >= greatest(8, ceil(length(lower(regexp_replace(r_name, '\\s+', '', 'g'))) * 0.4)) as matches from (
  select n_nationkey, r_name, (select count(*) from range(1, 40) t(i) where i <= least(length(n_name), length(r_name)) and lower(substr(n_name, 1, i::int)) = lower(substr(r_name, 1, i::int))) as pre from (select n_nationkey, replace(n_name, ' ', '') as n_name, replace(r_name, ' ', '') as r_name from nation join region on n_regionkey = r_regionkey)) b""")
def text_match_prefix(load):
    both = load("nation").join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", text.common_prefix("n_name", "r_name").cast("long").alias("shared"), text.prefix_match("n_name", "r_name").alias("matches"))


_PHRASES = {"english": "In  the", "spanish": "de la", "inner": "nd th"}


@query("""
with t as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as a from documents)
select doc_id, regexp_matches(a, '(^|[^a-z0-9])in the($|[^a-z0-9])') as english, regexp_matches(a, '(^|[^a-z0-9])de la($|[^a-z0-9])') as spanish, regexp_matches(a, '(^|[^a-z0-9])nd th($|[^a-z0-9])') as "inner" from t""")
def text_match_strict(load):
    """Phrases at word boundaries in whole documents."""
    return load("documents").select("doc_id", *[text.strict_match("text", F.lit(p)).alias(n) for n, p in _PHRASES.items()])


@query("""
with p as (select page_id, url, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) as root, regexp_replace(url, '#.*$', '') as bare, regexp_extract(html, '<a href="([^"]*)"', 1) as href from pages),
q as (select *, regexp_replace(regexp_extract(bare, '^[a-z]+://[^/?#]*([^?]*)', 1), '[^/]*$', '') as folder from p)
select page_id, root || href as a, root || case when folder = '' then '/' else folder end || page_id || '.html' as b, regexp_replace(bare, '\\?.*$', '') || '?k=' || page_id as c, scheme || '://o.org' || href as d,
  root || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || 'up' as e, bare || '#f' as f from q""")
def url_join(load):
    """Links of pages against the pages' own addresses."""
    href, pid = F.regexp_extract("html", '<a href="([^"]*)"', 1), F.col("page_id").cast("string")
    found = {"a": href, "b": F.concat(pid, F.lit(".html")), "c": F.concat(F.lit("?k="), pid), "d": F.concat(F.lit("//o.org"), href), "e": F.lit("../up"), "f": F.lit(" #f ")}
    return load("pages").select("page_id", *[urls.join("url", h).alias(n) for n, h in found.items()])


@query("""
select n_nationkey, case when n_nationkey % 3 = 0 then 7 when n_nationkey % 2 = 0 then 3 else 50 end as target, n_nationkey % 2 = 0 as backtracks, (round_even(100.0 * (n_nationkey % 8) / 8, 0)::int)::varchar || '% (' || (n_nationkey % 8) || '/8)' as rate from nation""")
def small_rules(load):
    k = F.col("n_nationkey")
    target = outcomes.target_count(F.when(k % 3 == 0, 7), F.when(k % 2 == 0, 3), F.lit(50), F.lit(True))
    path = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    back = outcomes.backtracks(path, F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("z"))))
    return load("nation").select("n_nationkey", target.alias("target"), back.alias("backtracks"), text.rate_text(k % 8, F.lit(8)).alias("rate"))


@query("""
with p as (select l_suppkey, l_partkey, '/a/' || l_returnflag as x, l_orderkey * 100 + l_linenumber as pos from lineitem),
o as (select l_suppkey, l_partkey % 199 as k, x, min(pos) as f from p group by all),
t as (select l_suppkey, k, first(x order by f, x) as a, last(x order by f, x) as b from o group by all having count(*) = 2),
u as (select l_suppkey, k, unnest([a, b]) as x, unnest([0, 1]) as i, a || ' | ' || b as pattern from t),
v as (select u.*, (select count(*) from p where p.l_suppkey = u.l_suppkey and p.l_partkey % 199 = u.k and p.x = u.x) as n from u)
select l_suppkey, k, pattern, string_agg(x, ' ' order by n desc, i) as chain from v group by all""")
def union_chain(load):
    rows = load("lineitem").select("l_suppkey", (F.col("l_partkey") % 199).alias("k"), F.concat(F.lit("/a/"), "l_returnflag").alias("x"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    patterns = votes.union_pattern(rows, ["l_suppkey", "k"], "x", "pos")
    chains = votes.union_chain(patterns, rows, ["l_suppkey", "k"], "pattern", "x")
    return patterns.join(chains, ["l_suppkey", "k"]).select("l_suppkey", "k", "pattern", F.array_join("chain", " ").alias("chain"))


@query("""
select event_id, array_to_string(list_transform(list_filter([(event_id % 4)::int, 9, (event_id % 3)::int + 1], lambda n: n is not null), lambda n: n), ',') as raw, case when event_id % 4 in (0, 1) then case when event_id % 3 = 0 then '1' else '1,' || (event_id % 3 + 1) end else case when event_id % 4 = event_id % 3 + 1 then (event_id % 4)::varchar else (event_id % 4) || ',' || (event_id % 3 + 1) end end as picked from events""")
def index_lists(load):
    s = lambda x: x.cast("string")
    raw = F.array(s(F.col("event_id") % 4), F.lit("9"), s(F.col("event_id") % 3 + 1))
    picked = text.index_list(F.concat(raw, F.array(F.lit("no"))), F.lit(5), 3)
    return load("events").select("event_id", F.array_join(raw, ",").alias("raw"), F.array_join(picked, ",").alias("picked"))


@query("select event_id, json_extract_string(props, '$.ref') as ref, json_extract_string(props, '$.k') as k from events")
def json_salvage(load):
    fenced = F.concat(F.lit("Result: "), F.lit("`" * 3), F.regexp_replace("props", r"\\}$", ",}"), F.lit(" done"))
    found = text.json_object_in(fenced)
    return load("events").select("event_id", F.get_json_object(found, "$.ref").alias("ref"), F.get_json_object(found, "$.k").alias("k"))


@query()
def text_similarity(load):
    return load("part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))
