"""Nested JSON payloads, made of the columns of events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from .registry import query

_PAYLOAD = """concat('{"id": ', event_id, ', "props": ', props, case event_type
  when 'click' then concat(', "usage_metadata": {"input_tokens": ', k, ', "output_tokens": ', v, '}')
  when 'view' then concat(', "message": {"additional_kwargs": {"usage": {"prompt_tokens": "', k, '", "total_tokens": ', v, '}}, "content": "{ \\\\"usage\\\\": ["}')
  when 'purchase' then concat(', "results": [{"n": 1}, [{"usage": {"input_tokens": ', k, '}}], {"completion_tokens": ', v, '}]')
  when 'error' then ', "error": {"usage": {}, "tokens": [1, 2]}'
  else concat(', "prompt_tokens": ', k, ', "usage": {"prompt_tokens": 999, "completion_tokens": ', v, '}') end, '}')"""


@query("""
with e as (select event_id, event_type, (props::json->>'k')::bigint as k, floor(value)::bigint as v from events)
select event_id, case event_type when 'purchase' then 0 else k end as prompt_tokens, case when event_type in ('click', 'purchase') then v else 0 end as completion_tokens, case event_type when 'click' then k + v when 'view' then v else 0 end as total_tokens
from e where event_type <> 'error'""")
def nested_token_usage(load):
    """Usage under several names at depths from zero to three, as numbers and as texts."""
    e = load("events").select("event_id", "event_type", "props", F.get_json_object("props", "$.k").alias("k"), F.floor("value").alias("v"))
    return payloads.token_usage(e.select("event_id", F.expr(_PAYLOAD).alias("payload")), ["event_id"], "payload")


_STATE = """concat('{"', event_type, '": {"last": ', event_id, ', "props": ', props, '}, "seen": ', case event_type when 'error' then 'true' when 'signup' then '{}' else concat('{"', event_type, '": [', v, ', {"u": ', user_id, '}]}') end, '}')"""


@query(f"""
with e as (select user_id, event_id, {_STATE}::json as j from (select *, floor(value)::bigint as v from events)),
m as (select user_id, list_reduce(list(j order by event_id), lambda a, b: json_merge_patch(a, b)) as j from e group by 1)
select user_id, t.fullkey as path, t.value::varchar as value from m, json_tree(m.j) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')""")
def merged_states(load):
    """Each user's states merged at every depth, as paths and values."""
    e = load("events").select("user_id", "event_id", "event_type", "props", F.floor("value").alias("v"))
    found = payloads.merged_leaves(e.select("user_id", "event_id", F.expr(_STATE).alias("payload")), ["user_id"], "event_id", "payload")
    path = F.concat(F.lit("$"), F.array_join(F.transform("path", lambda s: F.coalesce(F.concat(F.lit("."), s["name"]), F.concat(F.lit("["), s["at"].cast("string"), F.lit("]")))), ""))
    return found.select("user_id", path.alias("path"), F.col("text").alias("value"))


@query("""
select o_orderkey, substr(sha1('{"brief": {"a": {"b": true, "y": null}, "z": ' || o_custkey || '}, "fields": [{"kind": "' || o_orderpriority || '", "name": "priority"}, {"kind": "' || o_orderstatus || '", "name": "status"}], "max_pages": ' || o_orderkey || ', "thread_id": "' || o_orderdate::date || '"}'), 1, 16) as execution_id from orders""")
def execution_ids(load):
    """Digests of payloads with sorted names at every depth."""
    text = """concat('{"thread_id":"', cast(o_orderdate as date), '","fields":[{"name":"priority","kind":"', o_orderpriority, '"},{"name":"status","kind":"', o_orderstatus, '"}],"brief":{"z":', o_custkey, ',"a":{"y":null,"b":true}},"max_pages":', o_orderkey, '}')"""
    return payloads.execution_ids(load("orders").select("o_orderkey", F.expr(text).alias("payload")), ["o_orderkey"], "payload")
