"""Folds of a bounded number whose steps compose.

Each step changes a number x to min(max(x + add, low), high), and steps in a row are again such a step. With the sums s of
add so far, the composition has, beside the whole sum S, low = S + max over rows of min(low - s, least high - s from that row on)
and high = S + min over rows of high - s, or low where that is greater: two running windows and one aggregation, no array and no loop.
A log is cut into stretches before anything is ordered by key, so the rows of a hot key are worked on in
as many tasks as they fill, and only the composed steps of its stretches meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = 1 << 60  # no bound
SAME = {"add": 0, "low": -FAR, "high": FAR}  # the step that changes nothing


def stretches(rows: DataFrame, by: str, order: list[str | Column], **values: Column) -> DataFrame:
    """k, stretch and values: the log sorted by key and order over all tasks; the rows of a key in one task are a stretch, numbered in order, with pos from 1."""
    keys = {f"o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    log = rows.select(F.col(by).alias("k"), *[c.alias(n) for n, c in {**keys, **values}.items()])
    log = log.repartitionByRange("k", *keys, *values).withColumn("stretch", F.spark_partition_id())
    return log.withColumn("pos", F.row_number().over(Window.partitionBy("k", "stretch").orderBy(*keys, *values))).drop(*keys)


def clamped(rows: DataFrame, group: list[str], order: str, **more: Column) -> DataFrame:
    """add, low and high of each group's steps, composed in ``order`` (without ties in a group), with further aggregates."""
    so_far = F.sum("add").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    onwards = Window.partitionBy(*group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # backwards: a frame up to the end is counted anew for each row
    seen = rows.withColumn("s", so_far).withColumn("least", F.min(F.col("high") - F.col("s")).over(onwards))
    whole, low = F.sum("add"), F.max(F.least(F.col("low") - F.col("s"), "least"))
    high = F.greatest(low, F.min(F.col("high") - F.col("s")))
    return seen.groupBy(*group).agg(whole.alias("add"), (whole + low).alias("low"), (whole + high).alias("high"), *[c.alias(n) for n, c in more.items()])


def lowered(by: Column) -> dict[str, Column]:
    """The steps in the columns add, low and high after x has become max(x - by, 0)."""
    return {"low": F.least(F.greatest("add", "low"), "high"), "add": F.col("add") - by}


def at_zero() -> Column:
    """The composed step of 0."""
    return F.least(F.greatest("add", "low"), "high")
