"""The life of a run's items: claim, commit, fail, ack, release, by replay of an operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

_START = {"claim_state": "pending", "durability_state": "staged", "worker": "", "attempts": 0, "success": False, "refused": 0}
_KIND = "claim_state string, durability_state string, worker string, attempts int, success boolean, refused int"


def replay(log: DataFrame, item: str, op: str, worker: str, order: list[str]) -> DataFrame:
    """The state of each item after its log.

    A claim is refused while another worker holds the item and does nothing once it is final; commit and fail make it
    durable; an ack is refused before that; a release counts only from the worker that holds the staged item. Steps of an
    item are folded in order, as they stream through its task.
    """

    def step(s: list, o: str | None, by: str | None) -> None:
        durable = s[1] == "durable"
        final = durable or s[0] in ("committed", "acked", "failed")
        held = s[0] == "claimed"
        if o == "claim" and not final:
            if held and s[2] != by:
                s[5] += 1
            else:
                s[0], s[2], s[3] = "claimed", by, s[3] + 1
        elif o in ("commit", "fail") and not final:
            s[0], s[1], s[2], s[4] = "committed" if o == "commit" else "failed", "durable", by, o == "commit"
        elif o == "ack":
            if durable:
                s[0] = "acked"
            else:
                s[5] += 1
        elif o == "release" and held and s[2] == by and not durable:
            s[0], s[2] = "pending", ""

    return ordered_fold(log, item, order, [F.col(op), F.col(worker)], list(_START.values()), step, _KIND)


def resume_page(listed: DataFrame, known: DataFrame, page: str, pos: str, url: str) -> DataFrame:
    """The page to resume from: the last of the leading pages whose first URL is known (the first page at least)."""
    first = listed.groupBy(page).agg(F.min_by(url, pos).alias(url)).join(known.select(url).distinct().withColumn("seen", F.lit(1)), url, "left")
    gap = F.min(F.when(F.col("seen").isNull(), F.col(page)))
    return first.agg(F.greatest(F.coalesce(gap, F.max(page) + 1) - 1, F.min(page)).alias("page"))


def requested_only(rows: DataFrame, tokens: Column, requested: Column) -> DataFrame:
    """Rows of a requested category; all where none is requested."""
    return rows.where((F.size(requested) == 0) | F.arrays_overlap(tokens, requested))


def recent(rows: DataFrame, by: str, order: list[Column], n: int, text: Column) -> DataFrame:
    """The last ``n`` actions of a key in their order, as one list."""
    w = Window.partitionBy(by).orderBy(*[o.desc() for o in order])
    kept = rows.withColumns({"__n": F.row_number().over(w), "__t": text}).where(F.col("__n") <= n)
    return kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), "__t"))).alias("a")).select(by, F.transform("a", lambda s: s["__t"]).alias("actions"))
