"""Ordered folds: sliding windows, streaks, adaptive rates, loops."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import scans

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers need no copy of the package


def over(by: str, *order: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def stuck(rows: DataFrame, by: str, order: list[str], mark: Column, size: int = 8, repeats: int = 3) -> DataFrame:
    """Whether some mark occurs ``repeats`` times in the last ``size`` rows."""
    seen = F.collect_list(mark).over(over(by, *order).rowsBetween(-(size - 1), 0))
    most = F.array_max(F.transform(F.array_distinct("__seen"), lambda x: F.size(F.filter("__seen", lambda y: x == y))))
    return rows.withColumn("__seen", seen).withColumn("stuck", (F.size("__seen") >= repeats) & (most >= repeats)).drop("__seen")


def loops(rows: DataFrame, by: str, order: list[str], mark: Column) -> DataFrame:
    """ABAB over four rows, ABCABC over six, AAA over three (from the fourth row on)."""
    w = over(by, *order)
    back = {i: F.lag(mark, i).over(w) for i in range(1, 6)}
    n = F.row_number().over(w)
    abab = (mark == back[2]) & (back[1] == back[3])
    abcabc = (mark == back[3]) & (back[1] == back[4]) & (back[2] == back[5])
    aaa = (mark == back[1]) & (back[1] == back[2])
    return rows.withColumn("loop", (n >= 4) & F.coalesce(abab | abcabc | aaa, F.lit(False)))


def ordered_fold(rows: DataFrame, by: str, order: list[str | Column], values: list[Column], start: list, step: Callable[..., None], kind: str) -> DataFrame:
    """One row per key: ``by`` and the state after all its rows, with the columns of ``kind``.

    ``step`` changes the state, a list that begins as ``start``, by the values of one row. Rows come in
    ``order``, ties by their values, nulls first. A key's rows meet in one task but stream through it: only the state
    is kept from batch to batch, so a log may be of any length.
    """
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    picked = rows.select(F.col(by).alias("k"), *keys, *[v.alias(f"v{i}") for i, v in enumerate(values)])
    log = picked.repartition("k").sortWithinPartitions(*picked.columns).select("k", *[f"v{i}" for i in range(len(values))])
    fields = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, type_ = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.record_batch([pa.array(columns[0], type_), *[pa.array(c, f.type) for c, f in zip(columns[1:], fields, strict=True)]], names=[by, *fields.names])

        for batch in batches:
            type_, done = batch.column(0).type, []
            for k, *v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or (k != key and (k == k or key == key)):  # NaN is one key
                    if state is not None:
                        done.append((key, *state))
                    key, state = k, list(start)
                step(state, *v)
            if done:
                yield out(done)
        if state is not None:
            yield out([(key, *state)])

    return log.mapInArrow(run, StructType([StructField(by, rows.schema[by].dataType), *StructType.fromDDL(kind)]))


def rate_level(rows: DataFrame, by: str, order: list[str], penalty: Column, most: int = 3, credit: int = 5, base: float = 1.0, factor: float = 1.5) -> DataFrame:
    """The level of delay after all rows of a key: up on a penalty, down after ``credit`` successes in a row.

    Only penalties are steps, each after the drops that the successes since the last one bring. A hot key is cut into
    stretches that are worked on apart; see ``scans``.
    """
    log = scans.stretches(rows, by, order, bad=F.coalesce(penalty, F.lit(False)))
    bad_pos = F.when(F.col("bad"), F.col("pos"))
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(bad_pos, ignorenulls=True).over(before.partitionBy("k", "stretch"))
    drops = F.coalesce(F.floor((F.col("pos") - last - 1) / credit), F.lit(0))
    step = {"add": 1 - drops, "low": F.lit(min(1, most)), "high": F.lit(most)}
    steps = log.select("k", "stretch", "pos", bad_pos.alias("bad_pos"), *[F.when(F.col("bad"), c).otherwise(scans.SAME[n]).cast("long").alias(n) for n, c in step.items()])
    parts = scans.clamped(steps, ["k", "stretch"], "pos", n=F.count(F.lit(1)), first=F.min("bad_pos"), last=F.max("bad_pos"))
    # Places in the whole log of a key, to count the successes from one stretch to the next.
    earlier = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    parts = parts.select("*", (start + F.col("first")).alias("from"), (start + F.col("last")).alias("to"))
    drops = F.floor((F.col("from") - F.coalesce(F.last("to", ignorenulls=True).over(earlier), F.lit(0)) - 1) / credit)
    parts = parts.withColumn("drops", drops).withColumns({n: F.when(F.col("from").isNull(), F.col(n)).otherwise(c) for n, c in scans.lowered(F.col("drops")).items()})
    whole = scans.clamped(parts, ["k"], "stretch", n=F.sum("n"), last=F.max("to"))
    after = F.col("n") - F.coalesce("last", F.lit(0))
    level = F.greatest(scans.at_zero() - F.floor(after / credit), F.lit(0)).cast("int")
    out = whole.select(F.col("k").alias(by), level.alias("level"), (after % credit).cast("int").alias("streak"))
    return out.select(by, "level", "streak", F.round(base * F.pow(F.lit(factor), F.col("level")), 6).alias("delay"))


def strikes(rows: DataFrame, by: str, seconds: Column, idle: int = 120, base: float = 3.0, most: float = 60.0) -> DataFrame:
    """Strikes against a domain after its last event: one less for an idle time, one more for the event; the back-off doubles.

    Events without a time change nothing; NaN is the largest number. A hot key is cut into stretches; see ``scans``.
    """
    log = scans.stretches(rows, by, [], at=seconds.cast("double"))
    last = F.lag("at").over(Window.partitionBy("k", "stretch").orderBy("pos"))
    step = {"add": 1 - F.when(F.col("at") - last > idle, 1).otherwise(0), "low": F.lit(1), "high": F.lit(scans.FAR)}
    steps = log.select("k", "stretch", "pos", "at", *[F.when(F.col("at").isNotNull(), c).otherwise(scans.SAME[n]).cast("long").alias(n) for n, c in step.items()])
    parts = scans.clamped(steps, ["k", "stretch"], "pos", first=F.min("at"), last=F.max("at"))
    rested = F.col("first") - F.lag("last").over(Window.partitionBy("k").orderBy("stretch")) > idle
    parts = parts.withColumn("rested", F.coalesce(rested, F.lit(False))).withColumns({n: F.when(F.col("rested"), c).otherwise(F.col(n)) for n, c in scans.lowered(F.lit(1)).items()})
    strikes = F.greatest(scans.at_zero(), F.lit(0)).cast("int")
    out = scans.clamped(parts, ["k"], "stretch").select(F.col("k").alias(by), strikes.alias("strikes"))
    return out.select(by, "strikes", F.least(F.lit(most), base * F.pow(F.lit(2.0), F.col("strikes") - 1)).alias("backoff"))


def running(rows: DataFrame, by: str, order: list[str], **marks: Column) -> DataFrame:
    w = over(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(mark.cast("long")).over(w) for name, mark in marks.items()})


def budget(rows: DataFrame, by: str, order: list[str], wants: Column, most: int) -> DataFrame:
    """Replans up to ``most`` of a key, then aggregates."""
    out = running(rows, by, order, replans=wants)
    return out.withColumn("decision", F.when(~wants, "continue").when(F.col("replans") <= most, "replan").otherwise("aggregate"))


def no_growth(rows: DataFrame, by: str, order: list[str], item: str, rounds: int) -> DataFrame:
    """Per row whether ``rounds`` rows in a run brought no new item."""
    fresh = (F.row_number().over(over(by, *([item] + order)).partitionBy(by, item).orderBy(*order)) == 1).cast("int")
    w = over(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("fresh", fresh).withColumn("__run", F.sum("fresh").over(w))
    streak = F.sum(1 - F.col("fresh")).over(Window.partitionBy(by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("stale_rounds", streak).withColumn("stop", F.col("stale_rounds") >= rounds).drop("__run")


def last_failures(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def scroll_state(rows: DataFrame, by: str, order: list[str], page: str, bottom: Column, top: Column) -> DataFrame:
    """Bottom, then top, without leaving the page: fully scrolled."""
    w = over(by, *order)
    moved = F.coalesce((F.col(page) != F.lag(page).over(w)).cast("int"), F.lit(1))
    visit = rows.withColumn("__visit", F.sum(moved).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(by, "__visit").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return visit.withColumn("__low", F.max(bottom.cast("int")).over(v)).withColumn("fully_scrolled", F.max(((F.col("__low") == 1) & top).cast("int")).over(v) == 1).drop("__low", "__visit")
