"""Upserts, replacements and folds as new states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .history import latest


def upsert(known: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], keep: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """Last row wins by key; for columns in ``keep`` the last value that is not blank, in ``first`` the first not null.

    ``order`` sorts incoming rows; rows of known come before them. One aggregation
    with partial results, so a hot key is combined before it is shuffled.
    """
    rank = F.struct(F.lit(1).alias("src"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    base = F.struct(F.lit(0).alias("src"), *[F.lit(None).cast(t).alias(f"o{i}") for i, t in enumerate(x.dataType.simpleString() for x in incoming.select(*order).schema.fields)])
    rows = known.withColumn("__at", base).unionByName(incoming.withColumn("__at", rank))
    out = []
    for name in known.columns:
        if name in keys:
            continue
        at = F.col("__at")
        if name in keep:
            out.append(F.max_by(name, F.when(~is_blank(F.col(name).cast("string")), at)).alias(name))
        elif name in first:
            out.append(F.min_by(name, F.when(F.col(name).isNotNull(), at)).alias(name))
        else:
            out.append(F.max_by(name, at).alias(name))
    return rows.groupBy(*keys).agg(*out).select(*known.columns)


def replace_children(known: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that comes in are replaced, others stay."""
    return known.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def append_new(known: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows of new keys, the first of each."""
    fresh = latest(incoming, keys, order).join(known.select(*keys).distinct(), keys, "left_anti")
    return known.unionByName(fresh.select(*known.columns))


def counters(events: DataFrame, by: list[str], success: Column, at: str) -> DataFrame:
    """Success and failure counts with the time of the last of each."""
    return events.groupBy(*by).agg(
        F.count_if(success).alias("success_count"),
        F.count_if(~success).alias("failure_count"),
        F.max(F.when(success, F.col(at))).alias("last_success_at"),
        F.max(F.when(~success, F.col(at))).alias("last_failure_at"),
    )


def fold_configs(rows: DataFrame, by: list[str], pos: str, xpath: str = "xpath", validated: str = "validated", most: int = 5) -> DataFrame:
    """A field's configurations as one: the first validated with an xpath, else the first with one; the others are fallbacks, at most ``most``."""
    has = ~is_blank(xpath)
    best = F.min_by(xpath, F.when(has, F.struct((~F.col(validated)).alias("v"), F.col(pos).alias("p"), F.col(xpath).alias("x")))).alias(xpath)
    others = F.array_sort(F.collect_list(F.when(has, F.struct(F.col(pos).alias("p"), F.col(xpath).alias("x"))))).alias("__all")
    folded = rows.groupBy(*by).agg(best, others, F.bool_or(F.col(validated) & has).alias(validated))
    rest = F.array_remove(F.array_distinct(F.transform("__all", lambda s: s["x"])), F.col(xpath))
    return folded.withColumn("fallbacks", F.slice(rest, 1, most)).drop("__all")


def claim_step(claim: Column, durability: Column, worker: Column, by: Column) -> Column:
    """What a claim does to an item: (result, state)."""
    final = (durability == "durable") | claim.isin("committed", "acked", "failed")
    taken = (claim == "claimed") & (worker != by)
    return F.struct(F.when(final, "already_final").when(taken, "claimed_by_other").otherwise("claimed").alias("result"), F.when(final | taken, claim).otherwise("claimed").alias("claim_state"))


def release_for_resume(items: DataFrame, claim: str = "claim_state", durability: str = "durability_state") -> DataFrame:
    """Claimed and not durable items go back to pending; the durability stays as it is."""
    held = (F.col(claim) == "claimed") & (F.coalesce(F.col(durability), F.lit("")) != "durable")
    return items.withColumns({"released": held, claim: F.when(held, "pending").otherwise(F.col(claim))})


def deep_merge(current: Column, incoming: Column) -> Column:
    """Right side wins, key by key."""
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.map_contains_key(incoming, k)), incoming)
