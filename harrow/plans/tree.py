"""Plan trees as adjacency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def walk(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Every node below a root, however deep, with its depth and path; a depth-first reading orders by ``sort_path``.

    Each node points to an ancestor and holds the path from below it. In a round it takes over where its ancestor points,
    so the steps double: the rounds are the logarithm of the depth. Nodes below an unknown parent are left out; one that comes
    back below itself (its key may stand under several parents) is an error. A key under several parents has a row for each path.
    """
    ord_ = F.lpad(F.col(key).cast("string"), 20, "0")
    named = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(name).alias("label"))
    state = cut(named.select("*", F.col("up").alias("at"), F.lit(0).alias("depth"), F.col("label").cast("string").alias("path"), ord_.alias("sort_path")))
    most, reach = state.count(), 1
    # A pointer of None has passed the root; one that no node answers is dropped.
    while not state.where("at is not null").isEmpty():
        if reach > most:
            raise ValueError("cycle in the plan tree")
        above = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("d"), F.col("path").alias("p"), F.col("sort_path").alias("s"))
        joined = state.where("at is not null").join(above, "at")
        moved = joined.select("id", "up", "label", F.col("next").alias("at"), (F.col("depth") + F.col("d") + 1).alias("depth"), F.concat("p", F.lit(" > "), "path").alias("path"), F.concat("s", F.lit("/"), "sort_path").alias("sort_path"))
        state, reach = cut(state.where("at is null").select(*moved.columns).union(moved)), reach * 2
    return state.select("id", "up", "label", "depth", "path", "sort_path")


def sibling_sets(nodes: DataFrame, parent: str, leaf: str) -> DataFrame:
    return nodes.groupBy(parent).agg(F.array_sort(F.collect_set(leaf)).alias("siblings"))


def switches_sibling(registered: Column, current: Column, candidates: Column) -> Column:
    """All candidates (two at least) are registered siblings and one is not the current label."""
    return (F.size(candidates) >= 2) & (F.size(F.array_except(candidates, registered)) == 0) & F.exists(candidates, lambda x: x != current)


def same_group(current_path: Column, candidate_paths: Column) -> Column:
    """Every candidate has the current group, and one another leaf."""
    group, leaf = F.get(current_path, F.lit(0)), F.get(current_path, F.size(current_path) - 1)
    return F.forall(candidate_paths, lambda p: F.get(p, F.lit(0)) == group) & F.exists(candidate_paths, lambda p: F.get(p, F.size(p) - 1) != leaf)


def page_models(nodes: DataFrame, subtasks: DataFrame, key: str, leaf: Column, *urls: str) -> DataFrame:
    """Nodes as pages: the first URL that is not blank, the number of children or subtasks, the kind."""
    n = subtasks.groupBy(key).agg(F.count("*").alias("links"))
    url = F.coalesce(*[F.nullif(F.trim(F.col(u)), F.lit("")) for u in urls])
    return nodes.join(n, key, "left").select(key, url.alias("url"), F.coalesce("links", F.lit(0)).alias("links"), F.when(leaf, "list_page").otherwise("category").alias("page_type"))


def node_type(leaf: Column, raw: Column) -> Column:
    known = raw.isin("category", "list_page", "leaf", "stateful_list")
    return F.when(leaf & ~raw.isin("leaf", "stateful_list"), "leaf").when(known, raw).otherwise(F.when(leaf, "leaf").otherwise("category"))
