"""Run history: what the read side answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.states import iso
from ..functions.text import is_blank


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each trimmed, not blank key; the order of ``pos`` is that of the result."""
    clean = rows.withColumn(key, F.trim(F.col(key))).where(F.coalesce(F.col(key), F.lit("")) != "")
    return latest(clean, [key], [F.col(pos)]).orderBy(pos)


def latest_reusable(tasks: DataFrame, runs: DataFrame, task: str, started: str, run: str, state: str, reusable: str) -> DataFrame:
    """Each task with its newest reusable run; tasks without one go."""
    good = latest(runs.where(F.col(state) == reusable), [task], [F.col(started).desc(), F.col(run).desc()])
    return tasks.join(good, task)


def runs_of_url(tasks: DataFrame, runs: DataFrame, task: str, url: str, value: str, started: str, run: str) -> DataFrame:
    return runs.join(tasks.where(F.col(url) == value), task).orderBy(F.col(started).desc(), F.col(run).desc())


def recent_then_reusable(tasks: DataFrame, runs: DataFrame, task: str, updated: str, started: str, run: str, state: str, reusable: str, limit: int = 100) -> DataFrame:
    """The limit comes first, so fewer rows may be left."""
    return latest_reusable(tasks.orderBy(F.col(updated).desc(), F.col(task)).limit(limit), runs, task, started, run, state, reusable)


def projected(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """The named columns as a registry lists them: '' for null texts, ISO texts of times, 0 for null whole numbers, empty arrays and maps for null ones."""
    named = rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])

    def shown(name: str, kind: str) -> Column:
        if kind in ("timestamp", "timestamp_ntz", "date"):
            return iso(F.col(name).cast("timestamp") if kind == "date" else name)
        empty = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0)}.get(kind)
        if kind.startswith("array") or kind.startswith("map"):
            empty = (F.array() if kind.startswith("array") else F.create_map()).cast(kind)
        return F.col(name) if empty is None else F.coalesce(name, empty.cast(kind))

    return named.select(*[shown(n, k).alias(n) for n, k in named.dtypes])


def detail(runs: DataFrame, items: DataFrame, failures: DataFrame, run: str, order: str) -> DataFrame:
    """A row a run with its items and validation failures nested."""
    nest = lambda rows, into: rows.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (run, order)]))).alias(into))
    return runs.join(nest(items, "items"), run, "left").join(nest(failures, "validation_failures"), run, "left")


def identify(incoming: DataFrame, known: DataFrame, url: str = "normalized_url", state: str = "page_state_signature", signature: str = "semantic_signature", computed: str = "computed_signature", text: str = "task_description", key: str = "id") -> DataFrame:
    """The known task of each incoming one: by full identity; else among rows without signature by the computed one; without an incoming signature by text.

    Rows of incoming need a unique ``row``; the least key wins a tie.
    """
    old = known.select(*[F.col(k).alias(f"k_{k}") for k in (url, state, signature, computed, text, key)])
    near = incoming.join(old, (F.col(url) == F.col(f"k_{url}")) & (F.coalesce(F.col(state), F.lit("")) == F.coalesce(F.col(f"k_{state}"), F.lit(""))), "left")
    has, legacy = ~is_blank(signature), is_blank(f"k_{signature}")
    tier = (
        F.when(has & (F.col(signature) == F.col(f"k_{signature}")), 1)
        .when(has & legacy & (F.col(signature) == F.col(f"k_{computed}")), 2)
        .when(~has & legacy & (F.col(text) == F.col(f"k_{text}")), 3)
    )
    best = F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), F.col(f"k_{key}").alias("key")))).alias("m")
    return near.groupBy("row").agg(best).select("row", F.col("m.tier").alias("tier"), F.col("m.key").alias("task_key"))


def with_labels(tickets: DataFrame, labels: dict[str, str] | None, column: str = "labels") -> DataFrame:
    """All requested label pairs must be equal."""
    for k, v in (labels or {}).items():
        tickets = tickets.where(F.try_element_at(column, F.lit(k)) == v)
    return tickets


def first_profile(snapshots: DataFrame, by: str, order: list[Column], *candidates: str) -> DataFrame:
    """The first not empty profile over snapshots in order, the candidates of a snapshot tried in turn."""
    found = snapshots.withColumn("profile", F.coalesce(*[F.when(F.length(F.trim(F.col(x))) > 0, F.col(x)) for x in candidates]))
    return latest(found.where(F.col("profile").isNotNull()), [by], order).select(by, "profile")


def missing_columns(rows: DataFrame, expected: list[str]) -> DataFrame:
    spark = rows.sparkSession
    have = F.array(*map(F.lit, rows.columns))
    return spark.range(1).select(F.explode(F.array_except(F.array(*map(F.lit, expected)), have)).alias("column"))


def overlay(hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """The hot row where there is one, else the cold one."""
    rows = hot.withColumn("__cold", F.lit(0)).unionByName(cold.withColumn("__cold", F.lit(1)))
    return latest(rows, [key], [F.col("__cold")]).drop("__cold")
