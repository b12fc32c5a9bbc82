"""Ordered folds over events, queues and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch, lookups
from ..operators import folds as W
from ..streaming import queue
from .registry import query


@query("""
select event_id, list_max(list_transform(list_distinct(seen), lambda x: len(list_filter(seen, lambda y: y = x)))) >= 3 as stuck
from (select event_id, list(event_type) over (partition by user_id order by event_id rows between 7 preceding and current row) as seen from events)""")
def stuck_windows(load):
    return W.stuck(load("events"), "user_id", ["event_id"], F.col("event_type")).select("event_id", "stuck")


@query("""
select event_id, n >= 4 and coalesce((a = b2 and b1 = b3) or (a = b3 and b1 = b4 and b2 = b5) or (a = b1 and b1 = b2), false) as "loop" from (
  select event_id, event_type as a, row_number() over w as n, lag(event_type, 1) over w as b1, lag(event_type, 2) over w as b2, lag(event_type, 3) over w as b3, lag(event_type, 4) over w as b4, lag(event_type, 5) over w as b5
  from events window w as (partition by user_id order by event_id))""")
def action_loops(load):
    return W.loops(load("events"), "user_id", ["event_id"], F.col("event_type")).select("event_id", "loop")


@query("""
with recursive e as (select user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by event_id) as n from events),
fold as (
  select user_id, n, case when bad then 1 else 0 end as level, case when bad then 0 else 1 end as streak from e where n = 1
  union all
  select e.user_id, e.n, case when bad then least(level + 1, 3) when streak + 1 >= 5 then greatest(level - 1, 0) else level end, case when bad or streak + 1 >= 5 then 0 else streak + 1 end from fold join e on e.user_id = fold.user_id and e.n = fold.n + 1
)
select user_id, level, streak, round(pow(1.5, level), 6) as delay from fold where (user_id, n) in (select (user_id, max(n)) from e group by user_id)""")
def rate_level_fold(load):
    return W.rate_level(load("events"), "user_id", ["event_id"], F.col("event_type") == "error")


@query("""
with recursive e as (select user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
fold as (
  select user_id, n, t, 1 as strikes from e where n = 1
  union all
  select e.user_id, e.n, e.t, (case when e.t - fold.t > 120 then greatest(strikes - 1, 0) else strikes end) + 1 from fold join e on e.user_id = fold.user_id and e.n = fold.n + 1
)
select user_id, strikes, least(60.0, 3.0 * pow(2.0, strikes - 1)) as backoff from fold where (user_id, n) in (select (user_id, max(n)) from e group by user_id)""")
def domain_strikes(load):
    return W.strikes(load("events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@query("""
select event_id, count(*) filter (event_type = 'purchase') over w as completed, count(*) filter (event_type = 'error') over w as failed from events window w as (partition by user_id order by event_id rows unbounded preceding)""")
def running_progress(load):
    return W.running(load("events"), "user_id", ["event_id"], completed=F.col("event_type") == "purchase", failed=F.col("event_type") == "error").select("event_id", "completed", "failed")


@query("""
select event_id, case when event_type <> 'error' then 'continue' when count(*) filter (event_type = 'error') over (partition by user_id order by event_id rows unbounded preceding) <= 2 then 'replan' else 'aggregate' end as decision from events""")
def replan_budget(load):
    return W.budget(load("events"), "user_id", ["event_id"], F.col("event_type") == "error", 2).select("event_id", "decision")


@query("""
with f as (select *, (row_number() over (partition by user_id, event_type order by event_id) = 1)::int as fresh from events),
r as (select *, sum(fresh) over (partition by user_id order by event_id rows unbounded preceding) as run from f)
select event_id, sum(1 - fresh) over (partition by user_id, run order by event_id rows unbounded preceding) >= 3 as stop from r""")
def no_growth_stop(load):
    return W.no_growth(load("events"), "user_id", ["event_id"], "event_type", 3).select("event_id", "stop")


@query("select event_id from (select event_id, row_number() over (partition by user_id order by event_id desc) as n from events where event_type = 'error') where n <= 2")
def last_failures(load):
    return W.last_failures(load("events").where("event_type = 'error'"), "user_id", [F.col("event_id").desc()], 2).select("event_id")


@query("""
with v as (select *, coalesce((event_type <> lag(event_type) over (partition by user_id order by event_id))::int, 1) as moved from events),
w as (select *, sum(moved) over (partition by user_id order by event_id rows unbounded preceding) as visit from v),
x as (select *, max((event_id % 2 = 0)::int) over (partition by user_id, visit order by event_id rows unbounded preceding) as low from w)
select event_id, max((low = 1 and event_id % 3 = 0)::int) over (partition by user_id, visit order by event_id rows unbounded preceding) = 1 as fully_scrolled from x""")
def scroll_state(load):
    return W.scroll_state(load("events"), "user_id", ["event_id"], "event_type", F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).select("event_id", "fully_scrolled")


_PRIORITY = "cast(substr(o_orderpriority, 1, 1) as int)"


def _tickets(load):
    return load("orders").where("o_orderstatus = 'O'").withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("int"))


def _claim(load, strategy):
    return dispatch.claim(_tickets(load), strategy, 50, "o_orderkey", "priority", "o_custkey", "o_orderdate").select("o_orderkey", "rank")


def _claim_sql(order):
    return f"select o_orderkey, row_number() over (order by {order}, o_orderkey) as rank from orders where o_orderstatus = 'O' order by rank limit 50"


@query(_claim_sql("o_orderdate"))
def fifo_claim(load):
    return _claim(load, "fifo")


@query(_claim_sql(f"{_PRIORITY}, o_orderdate"))
def priority_claim(load):
    return _claim(load, "priority")


@query(_claim_sql(f"{_PRIORITY}, ('0x' || substr(sha1(o_custkey::varchar), 1, 8))::bigint, o_orderdate"))
def batch_aware_claim(load):
    return _claim(load, "batch_aware")


@query(f"select o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by {_PRIORITY}, o_orderdate, o_orderkey) as rank from orders where o_orderstatus = 'O') where rank <= 2")
def claim_by_label(load):
    return dispatch.claim_by_label(_tickets(load), "o_custkey", "priority", 2, "o_orderkey", "priority", "o_custkey", "o_orderdate").select("o_orderkey", "rank")


_STATES = ["registered", "queued", "dispatched", "running", "completed"]


@query("""
with s as (select event_id, user_id, case event_type when 'signup' then 'registered' when 'view' then 'queued' when 'click' then 'dispatched' when 'purchase' then 'running' else 'failed' end as status from events),
b as (select *, lag(status) over (partition by user_id order by event_id) as before from s)
select event_id, before, status from b where before <> status and not ((before = 'registered' and status in ('queued', 'cancelled')) or (before = 'queued' and status in ('dispatched', 'cancelled')) or (before = 'dispatched' and status in ('running', 'queued', 'failed', 'cancelled', 'timeout')) or (before = 'running' and status in ('completed', 'failed', 'expanded', 'cancelled', 'timeout')) or (before = 'failed' and status = 'queued'))""")
def illegal_transitions(load):
    named = F.create_map(*[F.lit(x) for kv in {"signup": "registered", "view": "queued", "click": "dispatched", "purchase": "running"}.items() for x in kv])
    log = load("events").withColumn("status", F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("failed")))
    return dispatch.illegal_transitions(log, "user_id", "status", ["event_id"]).select("event_id", "before", "status")


_OP = "case event_type when 'signup' then 'push' when 'view' then 'push' when 'click' then 'fetch' when 'purchase' then 'ack' else 'fail' end"


@query(f"""
with recursive e as (select user_id, {_OP} as op, row_number() over (partition by user_id order by event_id) as n from events),
fold as (
  select user_id, 0::bigint as n, 'absent' as state, 0 as retries, 0 as delivered, 0 as acked, 0 as dead, 0 as pushed from (select distinct user_id from e)
  union all
  select f.user_id, e.n,
    case when op = 'push' and state = 'absent' then 'queued' when op = 'fetch' and state = 'queued' then 'pending' when state = 'pending' and (op = 'ack' or (op = 'fail' and retries >= 3)) then 'absent' else state end,
    case when (op = 'push' and state = 'absent') or (state = 'pending' and (op = 'ack' or (op = 'fail' and retries >= 3))) then 0 when state = 'pending' and op = 'fail' then retries + 1 else retries end,
    delivered + (op = 'fetch' and state = 'queued')::int, acked + (op = 'ack' and state = 'pending')::int, dead + (op = 'fail' and state = 'pending' and retries >= 3)::int, pushed + (op = 'push' and state = 'absent')::int
  from fold f join e on e.user_id = f.user_id and e.n = f.n + 1
)
select user_id, state, retries, delivered, acked, dead, pushed from fold where (user_id, n) in (select (user_id, max(n)) from e group by user_id)""")
def queue_replay(load):
    return queue.replay(load("events").withColumn("op", F.expr(_OP)), "user_id", "op", ["event_id"])


@query("""
select event_id, last_value(case when event_type <> 'error' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as sibling_value from events""")
def sibling_config(load):
    return lookups.sibling(load("events"), "event_id", "user_id", "event_id", F.col("event_type") != "error", "value").select("event_id", "sibling_value")


@query("""
select r.event_id, coalesce(x.value, s.value) as value from events r
left join (select user_id, event_type, arg_max(value, event_id) as value from events where event_id % 2 = 0 group by all) x on r.user_id = x.user_id and r.event_type = x.event_type
left join (select event_type, arg_max(value, event_id) as value from events where event_id % 2 = 0 group by all) s on r.event_type = s.event_type where r.event_id % 2 = 1""")
def exact_then_semantic(load):
    events = load("events")
    requests = events.where("event_id % 2 = 1").select("event_id", "user_id", "event_type")
    return lookups.exact_then_semantic(requests, events.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_type"], "value", "event_id").select("event_id", "value")
