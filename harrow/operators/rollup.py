"""Roll-ups of runs, tickets, traces and merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_divide
from .history import latest


def summary(items: DataFrame, by: list[str], success: Column, durable: Column) -> DataFrame:
    total, good = F.count("*"), F.count_if(success)
    return items.groupBy(*by).agg(
        total.alias("total"), good.alias("success_count"), F.greatest(total - good, F.lit(0)).alias("failed_count"), F.round(safe_divide(good, total), 4).alias("success_rate"), F.bool_and(durable).alias("durable")
    )


def status_counts(rows: DataFrame, by: str, status: str, states: list[str], terminal: list[str]) -> DataFrame:
    """A column for each state, 0 where there is none, and whether all are terminal."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in states]
    return rows.groupBy(by).agg(F.count("*").alias("total"), *counts, F.bool_and(F.col(status).isin(terminal)).alias("complete"))


def first_wins(rows: DataFrame, url: str, order: list[Column]) -> DataFrame:
    """The first row of each URL over all sources; rows without one all stay. Marks the others as conflicts."""
    n = F.row_number().over(Window.partitionBy(url).orderBy(*order))
    named = rows.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn("conflict", n > 1)
    return named.unionByName(rows.where(F.coalesce(F.col(url), F.lit("")) == "").withColumn("conflict", F.lit(False)))


def first_failure(failures: DataFrame, by: str, pos: str, category: str, stale: tuple[str, ...] = ("rule_stale", "state_mismatch")) -> DataFrame:
    """replan by the first failure that asks for it, else aggregate."""
    first = F.min_by(category, F.when(F.col(category).isin(list(stale)), F.col(pos)))
    out = failures.groupBy(by).agg(first.alias("category"))
    return out.withColumn("strategy", F.when(F.col("category").isNotNull(), "replan").otherwise("aggregate"))


def token_usage(traces: DataFrame, by: list[str], prompt: Column, completion: Column, total: Column) -> DataFrame:
    used = F.coalesce(prompt, completion, total).isNotNull()
    return traces.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.count_if(used).alias("calls_with_usage"),
        F.coalesce(F.sum(prompt), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(completion), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"),
    )


def saga(completed: Column, failed: Column, total: Column) -> Column:
    return (total > 0) & (completed + failed >= total)


def dispatch_summary(states: DataFrame, by: list[str], status: str, collected: str) -> DataFrame:
    """Subtasks by status; failed are business and system failures together; collected counts where completed."""
    n = lambda *names: F.count_if(F.lower(F.trim(F.col(status))).isin(*names))
    return states.groupBy(*by).agg(
        F.count("*").alias("total"),
        n("completed").alias("completed"),
        n("business_failure", "system_failure").alias("failed"),
        n("no_data").alias("no_data"),
        n("expanded").alias("expanded"),
        F.coalesce(F.sum(F.when(F.lower(F.trim(F.col(status))) == "completed", F.col(collected))), F.lit(0)).alias("collected"),
    )


def last_states(subtasks: DataFrame, states: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Every subtask with its last runtime state; ``known`` says whether there is one."""
    return subtasks.join(latest(states, [key], order).withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merged_report(items: DataFrame, url: str, order: list[Column], included: Column) -> DataFrame:
    """One row: items of included subtasks, different URLs, conflicts (a URL's later items), subtasks left out."""
    kept = first_wins(items.where(included), url, order)
    n = kept.agg(F.count("*").alias("items"), F.count_if(~F.col("conflict")).alias("unique_items"), F.count_if("conflict").alias("conflicts"))
    return n.crossJoin(items.agg(F.count_if(~included).alias("left_out")))  # two single rows
