"""Scalar functions over URLs, texts, paths and failures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import outcomes, signatures, text, urls, xpaths
from .registry import ORACLES, query

_NETLOC = "lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1))"
_PATH = "coalesce(nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/')"
_PAIRS = "list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"


@query(f"""
with k as (select page_id, url, regexp_replace({_NETLOC}, '^www\\.', '') || {_PATH} as base, list_filter({_PAIRS}, lambda p: contains(p, '=') and split_part(p, '=', 2) <> '' and lower(split_part(p, '=', 1)) not in ('page', 'p', 'offset', 'start', 'pagenum', 'pn')) as kept from pages),
o as (select *, list_distinct(list_transform(kept, lambda p: split_part(p, '=', 1))) as keys from k)
select page_id, case when len(kept) = 0 then base else base || '?' || array_to_string(list_transform(list_sort(list_transform(range(1, len(kept) + 1), lambda i: {{'f': list_position(list_transform(kept, lambda p: split_part(p, '=', 1)), split_part(kept[i], '=', 1)), 'i': i}})), lambda s: kept[s.i]), '&') end as normalized from o""")
def url_normalize(load):
    return load("pages").select("page_id", urls.normalise("url").alias("normalized"))


@query(f"""
with k as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) || '://' || {_NETLOC} || {_PATH} as base,
  list_sort(list_transform(list_filter({_PAIRS}, lambda p: lower(split_part(p, '=', 1)) not in ('spm', 'from', 'from_source', 'fromsite', 'source', 'sourceid', 'session', 'sessionid', 'sid', 'timestamp', 'ts') and not starts_with(lower(split_part(p, '=', 1)), 'utm_')), lambda p: {{'k': split_part(p, '=', 1), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}})) as kept from pages)
select page_id, case when len(kept) = 0 then base else base || '?' || array_to_string(list_transform(kept, lambda s: case when s.v = '' then s.k else s.k || '=' || s.v end), '&') end as dedup from k""")
def url_dedup_form(load):
    return load("pages").select("page_id", urls.dedup_form("url").alias("dedup"))


@query(f"select page_id, regexp_replace({_NETLOC}, '^www\\.', '') as domain, substr(sha256(url), 1, 16) as hash_id, substr(sha1(url || ':' || page_id || ':s'), 1, 16) as registry_id from pages")
def url_identity(load):
    rid = urls.registry_id(F.col("url"), F.col("page_id").cast("string"), F.lit("s"))
    return load("pages").select("page_id", urls.domain("url").alias("domain"), urls.hash_id("url").alias("hash_id"), rid.alias("registry_id"))


@query(f"select page_id, url <> '' and length(url) <= 2048 and {_NETLOC} <> '' and regexp_matches(url, '^(?i:https?):') as valid, regexp_matches(trim(url), '^/|^(?i:https?)://[^/?#]+') as is_url from pages")
def url_valid(load):
    return load("pages").select("page_id", urls.valid("url").alias("valid"), text.semantic_type_ok("url", F.lit("url")).alias("is_url"))


@query("""
select p_partkey, string_split_regex(p_type, '\\s*[-—–:：/|]\\s*')[1] as head, regexp_matches(p_brand, '\\d{1,2}[-/]\\d{1,2}([-/]\\d{2,4})?') as date_like, regexp_full_match(p_brand, '[^\\d\\-+]*[-+]?\\d[\\d,.\\s]*[^\\d]*') as number_like from part""")
def semantic_type_check(load):
    v = lambda k: text.semantic_type_ok("p_brand", F.lit(k))
    return load("part").select("p_partkey", F.get(outcomes.category_path("p_type"), F.lit(0)).alias("head"), v("date").alias("date_like"), v("number").alias("number_like"))


@query("""
with e as (select event_id, case event_id % 7 when 0 then 'ReadTimeout' when 1 then 'ValueError' when 2 then 'HTTPForbidden' else 'SomeError' end as kind, case event_id % 5 when 0 then 'dom changed' when 1 then 'Captcha page' when 2 then 'xpath stale' else 'plain' end as message from events),
t as (select *, lower(regexp_replace(regexp_replace(kind, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) || ' ' || lower(message) as told from e),
x as (select event_id, case when contains(told, 'timeout') then 'transient' when contains(told, 'dom changed') then 'state_mismatch' when contains(told, 'xpath stale') then 'rule_stale' when contains(told, 'captcha') or contains(told, 'forbidden') then 'site_defense' else 'fatal' end as category, event_id % 4 as failures from t)
select event_id, category, case category when 'transient' then case when failures >= 2 then 'fail' else 'retry' end when 'state_mismatch' then 'replan' when 'rule_stale' then 'replan' when 'site_defense' then 'human_intervention' else 'fail' end as action, case when category = 'transient' and failures < 2 then case failures when 0 then 1.0 else 2.0 end else 0.0 end as delay from x""")
def failure_recovery(load):
    kind = F.when(F.col("event_id") % 7 == 0, "ReadTimeout").when(F.col("event_id") % 7 == 1, "ValueError").when(F.col("event_id") % 7 == 2, "HTTPForbidden").otherwise("SomeError")
    message = F.when(F.col("event_id") % 5 == 0, "dom changed").when(F.col("event_id") % 5 == 1, "Captcha page").when(F.col("event_id") % 5 == 2, "xpath stale").otherwise("plain")
    told = load("events").select("event_id", outcomes.failure(kind, message)["category"].alias("category"))
    r = told.withColumn("r", outcomes.recovery("category", F.col("event_id") % 4, F.lit(2)))
    return r.select("event_id", "category", F.col("r.action").alias("action"), F.col("r.delay_seconds").alias("delay"))


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' and l_linestatus = 'F' then 'system_failure' when l_returnflag = 'N' then 'no_data' when l_linestatus <> 'O' then 'system_failure' when l_quantity < 10 then 'business_failure' else 'completed' end as status from lineitem""")
def subtask_status(load):
    error = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "x")
    state = F.when(F.col("l_returnflag") == "N", "no_data").otherwise("done")
    durable = F.when(F.col("l_linestatus") == "O", "durable")
    done = F.when(F.col("l_quantity") < 10, 0).otherwise(1)
    return load("lineitem").select("l_orderkey", "l_linenumber", outcomes.subtask_status(F.lit(""), F.lit(""), state, durable, error, done).alias("status"))


@query("""
with n as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from documents)
select doc_id, count(*) over (partition by t) as n_equal, min(doc_id) over (partition by t) as first_equal, length(t) as n_chars from n""")
def text_match(load):
    docs = load("documents").select("doc_id", text.normalise("text").alias("t"))
    same = docs.groupBy("t").agg(F.count("*").alias("n_equal"), F.min("doc_id").alias("first_equal"))
    return docs.join(same, "t").select("doc_id", "n_equal", "first_equal", F.length("t").cast("long").alias("n_chars"))


@query("""select conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(https?://[^\\s<>"'']+)', 1), lambda u: regexp_replace(u, '[.,;:!?)\\]}]+$', '')), lambda u: regexp_matches(u, '^https?://[^/?#]+')), ' ') as urls from conversations""")
def chat_urls(load):
    return load("conversations").select("conv_id", "turn", F.coalesce(F.array_join(text.chat_urls("text"), " "), F.lit("")).alias("urls"))


@query("""select page_id, contains(regexp_replace(regexp_replace(regexp_replace(lower(html), '<script.*?</script>', ' ', 'gs'), '<style.*?</style>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), 'the') as present from pages""")
def page_keyword_presence(load):
    return load("pages").select("page_id", text.keywords_present("html", F.array(F.lit("the"))).alias("present"))


@query("""
select c_custkey, substr(sha1('{"anchor_url": "' || c_mktsegment || '", "task": ' || to_json(c_name) || '}'), 1, 16) as profile, 'collect_' || substr(sha1(c_name), 1, 10) as subtask, case when length(c_name) > 10 then substr(c_name, 1, 10) || '...' else c_name end as short from customer""")
def signatures_of_tasks(load):
    p = signatures.profile(task=F.col("c_name"), anchor_url=F.col("c_mktsegment"))
    return load("customer").select("c_custkey", p.alias("profile"), signatures.subtask_id(F.lit("collect"), F.col("c_name")).alias("subtask"), text.compact("c_name", 10).alias("short"))


@query("""
with x as (select l_orderkey, l_linenumber, '//div[' || l_linenumber || ']' || case l_returnflag when 'A' then '//*[@id="m"]' when 'N' then '/ul[@class="popup"]' else '' end || '/a[' || (l_partkey % 9) || ']' as p from lineitem)
select l_orderkey, l_linenumber, regexp_replace(p, '\\[\\d+\\]', '', 'g') as bare,
  round(case when contains(p, '@id=') then 3.0 else 0.0 end + case when contains(p, '@class') then 0.8 - 1.8 else 0.0 end - 0.4, 6) as stability,
  not (contains(p, '@id=') or contains(p, '@class=')) and contains(substr(p, 3), '//') as broad from x""")
def xpath_functions(load):
    middle = F.when(F.col("l_returnflag") == "A", '//*[@id="m"]').when(F.col("l_returnflag") == "N", '/ul[@class="popup"]').otherwise("")
    p = F.concat(F.lit("//div["), F.col("l_linenumber").cast("string"), F.lit("]"), middle, F.lit("/a["), (F.col("l_partkey") % 9).cast("string"), F.lit("]"))
    found = load("lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return found.select("l_orderkey", "l_linenumber", xpaths.bare("p").alias("bare"), xpaths.stability("p").alias("stability"), xpaths.over_broad("p").alias("broad"))


_ASKED = "case o_orderstatus when 'F' then ' Category' when 'O' then 'none' else o_orderpriority end as asked"
_HOW = "case when substr(o_orderpriority, 1, 1) in ('1', '2', '5') then 'MANUAL ' else o_orderpriority end as how"


@query(f"""
with o as (select *, {_ASKED}, {_HOW} from orders),
n as (select o_orderkey, o_custkey % 4 as per, o_orderkey - 100 as total, lower(trim(asked)) = 'category' as grouped, list_filter(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), lambda x: x <> '' and x <> '5') as wanted, lower(trim(how)) = 'manual' as manual, substr(o_orderpriority, 1, 1) = '5' as bare from o)
select o_orderkey, case when grouped then 'category' else 'none' end as group_by, case when grouped and per > 0 then per end::integer as per_group_target_count, case when total > 0 then total end::integer as total_target_count,
  case when grouped and manual and not bare then 'manual' else 'auto' end as category_discovery_mode, case when grouped and manual and not bare then array_to_string(wanted, ',') else '' end as requested_categories from n""")
def grouping_rules(load):
    """Grouping settings of orders in normal form: those of open orders are cleared, manual ones without categories become auto."""
    o = load("orders").selectExpr("*", _ASKED, _HOW)
    bare = F.substring("o_orderpriority", 1, 1) == "5"
    requested = F.when(bare, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.split("o_orderpriority", "-"))
    g = outcomes.grouping(F.col("asked"), F.col("how"), (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") - 100).cast("string"), requested, requested)
    return o.select("o_orderkey", g.alias("g")).select("o_orderkey", "g.group_by", "g.per_group_target_count", "g.total_target_count", "g.category_discovery_mode", F.array_join("g.requested_categories", ",").alias("requested_categories"))


@query("""
select page_id, case when regexp_matches(url, '[?&]page=') then regexp_replace(url, '([?&]page=)[^&#]*', '\\1' || page_id) else url end as renumbered from pages""")
def page_numbers(load):
    """Addresses of pages with their page parameter set to another number."""
    return load("pages").select("page_id", urls.with_page("url", F.col("page_id")).alias("renumbered"))


@query(f"""
select n.page_id, n.normalized as normalized_url, trim(regexp_extract(p.html, '<html lang="([^"]*)"', 1)) as page_state_signature, coalesce(nullif(trim(regexp_extract(p.html, '<a href="([^"]*)"', 1)), '/the'), '') as anchor_url, '' as variant_label
from ({ORACLES["url_normalize"]}) n join pages p on p.page_id = n.page_id""")
def lookup_keys(load):
    """The identity of each page: normal address, state, anchor and variant, blank where there is none."""
    anchor = F.nullif(F.concat(F.lit(" "), F.regexp_extract("html", '<a href="([^"]*)"', 1)), F.lit(" /the"))
    key = urls.lookup_key(F.col("url"), F.regexp_extract("html", '<html lang="([^"]*)"', 1), anchor, F.lit(None).cast("string"))
    return load("pages").select("page_id", key.alias("k")).select("page_id", "k.*")


@query("""
select l_orderkey, l_linenumber, l_linestatus = 'F' and l_returnflag <> 'N' and l_shipmode not in ('AIR', 'RAIL') as reliable from (select *, case l_linenumber % 4 when 0 then 'AIR' when 1 then 'RAIL' else 'SHIP' end as l_shipmode from lineitem)""")
def reliable_lines(load):
    """Lines as results: completed, durable, and neither empty nor expanded."""
    execution = F.when(F.col("l_linestatus") == "F", " Completed").otherwise("running")
    durability = F.when(F.col("l_returnflag") != "N", "DURABLE").otherwise("staged")
    outcome = F.when(F.col("l_linenumber") % 4 == 0, "no_data ").when(F.col("l_linenumber") % 4 == 1, "expanded").otherwise("success")
    return load("lineitem").select("l_orderkey", "l_linenumber", outcomes.reliable(execution, durability, outcome).alias("reliable"))


@query("""
with e as (select event_id, event_type, floor(value / 50)::bigint as page, lag(floor(value / 50)::bigint) over w as before, list_filter([lag(event_type, 2) over w, lag(event_type) over w], lambda x: x is not null) as own from events window w as (partition by user_id order by event_id))
select event_id, coalesce(page = before, false) and len(own) > 0 and list_contains(own, event_type) as cycle from e""")
def category_cycles(load):
    """Events that stay on a page and repeat one of a user's last two kinds, as category paths."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.filter(F.array(F.lag("event_type", 2).over(w), F.lag("event_type").over(w)), lambda x: x.isNotNull())
    e = load("events").withColumns({"own": own, "page": F.floor(F.col("value") / 50).cast("string")}).withColumn("before", F.lag("page").over(w))
    cycle = outcomes.category_cycle(F.col("before"), F.concat(F.lit(" "), "page"), F.col("own"), F.array_append("own", F.upper("event_type")))
    return e.select("event_id", cycle.alias("cycle"))


@query("""
select p_partkey, replace(lower(p_brand), '#', '') in ('brand1', 'brand23') or contains(lower(p_type), 'brass') as context from part""")
def context_fields(load):
    """Parts as fields: those whose brand is an alias or whose type holds a marker."""
    name = F.concat(F.lit(" "), F.regexp_replace("p_brand", "#", "_ "))
    return load("part").select("p_partkey", outcomes.context_like(name, F.col("p_type"), ["brand1", "brand23"], ["brass"]).alias("context"))
