"""Tickets: order of dispatch, claims, transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The allowed transitions of a ticket.
TRANSITIONS = {
    "registered": ["queued", "cancelled"],
    "queued": ["dispatched", "cancelled"],
    "dispatched": ["running", "queued", "failed", "cancelled", "timeout"],
    "running": ["completed", "failed", "expanded", "cancelled", "timeout"],
    "failed": ["queued"],
    "timeout": ["queued"],
}
TERMINAL = ["completed", "failed", "expanded", "cancelled"]


def _cluster(envelope: Column) -> Column:
    return F.conv(F.substring(F.sha1(envelope.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


STRATEGIES: dict[str, Callable[[Column, Column, Column], list[Column]]] = {
    "fifo": lambda priority, envelope, created: [created],
    "priority": lambda priority, envelope, created: [priority, created],
    "batch_aware": lambda priority, envelope, created: [priority, _cluster(envelope), created],
}


def claim(tickets: DataFrame, strategy: str, size: int, key: str, priority: str, envelope: str, created: str) -> DataFrame:
    """The next ``size`` tickets in the order of a strategy; ties by key. A top-k, with its rank."""
    order = [*STRATEGIES[strategy](F.col(priority), F.col(envelope), F.col(created)), F.col(key)]
    top = tickets.orderBy(*order).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def claim_by_label(tickets: DataFrame, label: str, strategy: str, size: int, key: str, priority: str, envelope: str, created: str) -> DataFrame:
    """The next ``size`` tickets of each label."""
    order = [*STRATEGIES[strategy](F.col(priority), F.col(envelope), F.col(created)), F.col(key)]
    return tickets.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("rank") <= size)


def illegal_transitions(log: DataFrame, ticket: str, status: str, order: list[str]) -> DataFrame:
    """Status changes that the transition table does not allow: a data-quality report."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    w = Window.partitionBy(ticket).orderBy(*order)
    steps = log.withColumn("before", F.lag(status).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
    return steps.where(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col(status)), F.lit(False)))


def after_failure(attempt: Column, most: Column) -> Column:
    return F.when(attempt < most, "queued").otherwise("failed")


def cancel(tickets: DataFrame, which: Column, status: str = "status") -> DataFrame:
    return tickets.withColumn(status, F.when(which & ~F.col(status).isin(TERMINAL), "cancelled").otherwise(F.col(status)))


def spawn(expanded: DataFrame, ticket: str, children: str, envelope: str) -> DataFrame:
    """A queued ticket for each child of an expanded one."""
    return expanded.select(F.col(envelope), F.col(ticket).alias("parent_ticket_id"), F.posexplode(children).alias("child_no", "payload")).withColumns({ticket: F.concat_ws(":", "parent_ticket_id", "child_no"), "status": F.lit("queued"), "attempt_count": F.lit(0)})


def unexpired(tickets: DataFrame, status: str, updated: str, now: Column, seconds: int = 3600) -> DataFrame:
    """Terminal tickets go ``seconds`` after their last change."""
    return tickets.where(~(F.col(status).isin(TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp(updated) >= seconds)))


def trim(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The newest ``most`` rows of a stream: a top-k."""
    return rows.orderBy(*order).limit(most)
