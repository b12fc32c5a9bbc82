"""Lookup joins: siblings, parents, overlays, prefix matches, candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix, normalise
from .history import latest


def new_only(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def inherit(rows: DataFrame, key: str, parent: str, column: str) -> DataFrame:
    """The parent's value where a row has none."""
    up = rows.select(F.col(key).alias(parent), F.col(column).alias("__up"))
    return rows.join(up, parent, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), "__up")).drop("__up").select(*rows.columns)


def sibling(rows: DataFrame, key: str, parent: str, order: str, good: Column, value: str) -> DataFrame:
    """For each row the value of the latest good row before it under the same parent, itself excluded."""
    w = Window.partitionBy(parent).orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("sibling_value", F.last(F.when(good, F.col(value)), ignorenulls=True).over(w))


def exact_then_semantic(requests: DataFrame, cache: DataFrame, exact: list[str], semantic: list[str], value: str, pos: str) -> DataFrame:
    """The last value written under the full key, else under the key without page state."""
    last = lambda by, name: cache.groupBy(*by).agg(F.max_by(value, pos).alias(name))
    both = requests.join(last(exact, "__exact"), exact, "left").join(last(semantic, "__semantic"), semantic, "left")
    return both.withColumn(value, F.coalesce("__exact", "__semantic")).drop("__exact", "__semantic")


def longest_prefix(texts: DataFrame, marks: DataFrame, by: str, text: str, mark_text: str, mark: str, least: int = 8, share: float = 0.4) -> DataFrame:
    """For each text the marks of the same page with the longest common prefix, ties kept, if it is long enough."""
    near = texts.join(marks, by).withColumn("shared", common_prefix(text, mark_text))
    need = F.greatest(F.lit(least), F.ceil(F.length(normalise(text)) * share))
    w = Window.partitionBy(by, text)
    return near.where(F.col("shared") >= need).withColumn("__most", F.max("shared").over(w)).where("shared = __most").drop("__most")


def best_candidate(rows: DataFrame, by: str, value: str, score: Column, pos: str, gap: float = 1.0) -> DataFrame:
    """The best candidate of a key, unless it scores below 0 or another value comes within ``gap``."""
    scored = rows.withColumn("score", score).withColumn("__norm", normalise(value))
    first = latest(scored, [by], [F.col("score").desc(), F.col(pos), F.col("__norm")])
    other = scored.join(first.select(by, F.col("__norm").alias("__best")), by).where("__norm <> __best").groupBy(by).agg(F.max("score").alias("__second"))
    return first.join(other, by, "left").where((F.col("score") >= 0) & (F.col("__second").isNull() | (F.col("score") - F.col("__second") >= gap))).drop("__norm", "__second")


def tiered(rows: DataFrame, by: str, tier: Column, pos: str) -> DataFrame:
    """The first row of the lowest tier of a key; tiers are null for what does not match."""
    return latest(rows.withColumn("tier", tier).where("tier is not null"), [by], [F.col("tier"), F.col(pos)])


def unique_tier(rows: DataFrame, by: str, tiers: list[Column], value: str) -> DataFrame:
    """The value of the first tier that settles a key: one match is taken, several are ambiguous, none is not found."""
    aggs = [F.count_if(t).alias(f"n{i}") for i, t in enumerate(tiers)] + [F.min(F.when(t, F.col(value))).alias(f"v{i}") for i, t in enumerate(tiers)]
    out = rows.groupBy(by).agg(*aggs)
    status, pick = F.lit("not_found"), F.lit(None).cast(rows.schema[value].dataType)
    for i in reversed(range(len(tiers))):
        n = F.col(f"n{i}")
        pick = F.when(n == 1, F.col(f"v{i}")).when(n == 0, pick)
        status = F.when(n == 1, f"tier_{i}").when(n > 1, "ambiguous").otherwise(status)
    return out.select(by, status.alias("status"), pick.alias(value))


def rank_candidates(rows: DataFrame, by: str, label: Column, score: Column, order: list[Column], most: int) -> DataFrame:
    """Candidates with the first of each label, by score, at most ``most`` of a key."""
    named = rows.withColumns({"__l": F.lower(F.trim(label)), "score": score})
    once = latest(named, [by, "__l"], [F.col("score").desc(), *order])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), *order))).where(F.col("rank") <= most).drop("__l")
