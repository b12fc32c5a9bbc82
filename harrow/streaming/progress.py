"""Progress of runs as a stream: snapshots and counts by key that a replayed batch doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import blank_to_null

# The fields of a snapshot, and those that may stand in its queue instead.
CANONICAL = ("stage", "resume_mode", "thread_id", "released_claims", "recovered_pending", "stream_length", "pending_count")
IN_QUEUE = ("stream_length", "pending_count")


def events(spark: SparkSession, path: str, schema: str | StructType, batch: int = 16) -> DataFrame:
    """JSON event files as a stream of at most ``batch`` files a time. Each consumer group reads with a checkpoint of its own, which is its offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).json(path)


def canonical(state: Column | str) -> Column:
    """The canonical fields of a runtime state (JSON text) that are not null; those of its queue where the state itself has none."""
    state = F.col(state) if isinstance(state, str) else state
    at = lambda path: blank_to_null(F.get_json_object(state, path))
    fields = {n: F.coalesce(at(f"$.{n}"), at(f"$.queue.{n}")) if n in IN_QUEUE else at(f"$.{n}") for n in CANONICAL}
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def keyed_sink(path: str, keys: list[str], order: list[str], counts: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch leaves the last row of its keys, and its counts, in a folder named after the batch.

    A batch that is run again, whole or after a loss halfway, replaces its own folder, so nothing counts twice; nothing of
    other batches is read or rewritten, however large the table is.
    """
    totals = {n: F.sum(c.cast("long")) for n, c in (counts or {}).items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.struct(*order))
        rows = batch.groupBy(*keys).agg(newest.alias("last"), *[c.alias(f"n_{n}") for n, c in totals.items()])
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], order: list[str], counts: tuple[str, ...] = ()) -> DataFrame:
    """keys, the columns of each key's last row over all batches, and its counts summed. Of equal order the later batch wins."""
    rows = spark.read.parquet(path)
    newest = F.max_by("last", F.struct(*[f"last.{o}" for o in order], "batch"))
    out = rows.groupBy(*keys).agg(newest.alias("last"), *[F.sum(f"n_{n}").alias(n) for n in counts])
    return out.select(*keys, "last.*", *counts)


def compact(spark: SparkSession, path: str, into: str, keys: list[str], order: list[str], counts: tuple[str, ...] = ()) -> None:
    """One folder with the state of all batches of ``path``, as batch -1 of the new path ``into``."""
    own = current(spark, path, keys, order, counts)
    last = F.struct(*[c for c in own.columns if c not in keys and c not in counts])
    own.select(*keys, last.alias("last"), *[F.col(n).alias(f"n_{n}") for n in counts]).write.parquet(f"{into}/batch=-1")
