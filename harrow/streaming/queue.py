"""A reliable work queue: one state machine, as a batch replay of a log and as a stateful stream.

Operations on an item: push (only if it is not there: deduplication lasts while it is
in flight), fetch, ack (forgets it), fail (counts a retry; beyond ``most`` it goes to the
dead letters), release (back to the queue, no failure counted), recover (delivered again).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import ordered_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need no copy of the package

STATE = "state string, retries int, delivered int, acked int, dead int, pushed int"
_FIELDS = ["state", "retries", "delivered", "acked", "dead", "pushed"]


def replay(log: DataFrame, item: str, op: str, order: list[str], most: int = 3) -> DataFrame:
    """The state of each item after its log, which streams through the item's task."""
    return ordered_fold(log, item, order, [F.col(op)], ["absent", 0, 0, 0, 0, 0], lambda s, o: _apply(s, o, most), STATE)


def _apply(s: list, op: str | None, most: int) -> None:
    state = s[0]
    if op == "push" and state == "absent":
        s[0], s[1], s[5] = "queued", 0, s[5] + 1
    elif op == "fetch" and state == "queued":
        s[0], s[2] = "pending", s[2] + 1
    elif state == "pending":
        if op == "recover":
            s[2] += 1
        elif op == "release":
            s[0] = "queued"
        elif op == "ack":
            s[0], s[1], s[3] = "absent", 0, s[3] + 1
        elif op == "fail" and s[1] < most:
            s[1] += 1
        elif op == "fail":
            s[0], s[1], s[4] = "absent", 0, s[4] + 1


def stream(log: DataFrame, item: str, op: str, order: str, most: int = 3, idle_ms: int | None = None) -> DataFrame:
    """The same machine over a streaming log: a row with the new state for each item of a micro-batch.

    Operations of an item must arrive in the order of their micro-batches; within one they are sorted. With ``idle_ms``
    an item that stays pending that long is recovered, by a processing-time timer.
    """
    kind = f"{item} {log.schema[item].dataType.simpleString()}, {STATE}"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else ["absent", 0, 0, 0, 0, 0]
        if state.hasTimedOut:
            _apply(s, "recover", most)
        else:
            rows = pd.concat(list(frames)).sort_values(order)
            for o in rows[op]:
                _apply(s, o, most)
        state.update(tuple(s))
        if idle_ms is not None and s[0] == "pending":
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[key[0], *s]], columns=[item, *_FIELDS])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return log.groupBy(item).applyInPandasWithState(update, kind, STATE, "update", timeout)


def stats(states: DataFrame, by: Column) -> DataFrame:
    return states.groupBy(by.alias("consumer")).agg(F.count("*").alias("items"), F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "pending").alias("pending"), F.sum("dead").alias("dead_letters"))


def drained(states: DataFrame) -> DataFrame:
    """One row: whether nothing is queued or pending."""
    return states.agg((F.count_if(F.col("state") != "absent") == 0).alias("drained"))


def dedup_events(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events of a stream once each, within a watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, at: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of a stream in tumbling windows of event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).count().select(F.col("window.start").alias("start"), by, "count")


def sliding(events: DataFrame, at: str, by: str, width: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts in windows that overlap; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide), by).count().select(F.col("window.start").alias("start"), by, "count")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).count().select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "count")


def matched(left: DataFrame, right: DataFrame, key: str, at: str, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of two streams with the same key, the right one at most ``within`` after the left one; watermarks bound the state."""
    a = left.withWatermark(at, late).alias("a")
    b = right.withWatermark(at, late).alias("b")
    near = F.col(f"b.{at}").between(F.col(f"a.{at}"), F.col(f"a.{at}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def next_tasks(retried: DataFrame, recovered: DataFrame, fresh: DataFrame, order: list[str], size: int) -> DataFrame:
    """The next ``size`` tasks: those to be tried again first, then recovered ones, then those of the queue. A top-k."""
    ranked = [rows.withColumn("source", F.lit(i)) for i, rows in enumerate((retried, recovered, fresh))]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).orderBy("source", *order).limit(size)
